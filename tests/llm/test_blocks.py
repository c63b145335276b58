"""Blocks of the benchmark, and tables that operators write between their steps."""

import os

import numpy as np
import pytest
from quillrank.llm import common, decontaminate


@pytest.mark.parametrize("n", [1, 12, 13, 14, 50])
def test_pieces_of_an_item_hold_all_its_windows(n):
    ws = [b"w%d" % k for k in range(n)]
    cut = [p for p, _ in decontaminate.pieces(ws, 13, 60)]
    windows = lambda x: {tuple(x[k : k + 13]) for k in range(max(1, len(x) - 12))}
    assert set().union(*map(windows, cut)) == windows(ws)
    assert n < 50 or len(cut) > 1


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    real = decontaminate.hash_spans

    def weak(eight, starts, lens, seed=0):
        return real(eight, starts, lens, seed) & np.uint64(3)

    monkeypatch.setattr(decontaminate, "hash_spans", weak)
    block = decontaminate.Block([("1", [b"one", b"two"]), ("2", [b"three", b"four"]), ("3", [b"five", b"six"])], 2)
    assert len(block.hashes) <= 4 and len(block.windows) == 3
    monkeypatch.undo()
    block.choose({})
    block_of_all = decontaminate.Block([("1", [b"one", b"two"]), ("2", [b"three", b"four"])], 2)
    assert len(block_of_all.hashes) == 4


def test_written_tables_are_deleted_and_a_cluster_needs_a_shared_folder(spark):
    common.clean(spark)
    where = common.shared_dir(spark)
    before = set(os.listdir(where))
    assert common.written(spark.range(3)).count() == 3
    assert len(set(os.listdir(where)) - before) == 1
    assert common.clean(spark) == 1 and set(os.listdir(where)) == before

    class Cluster:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)
