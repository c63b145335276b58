"""Scoring of op1 part by part: the same sums however texts are cut, and no table of n-grams on disk."""

import os
import random

from pyspark.sql import functions as F
from quillrank.llm import common, kneser_ney


def held() -> int:
    return sum(os.path.getsize(os.path.join(at, f)) for path in common._written for at, _, files in os.walk(path.removeprefix("file:")) for f in files if f.endswith(".parquet"))


def test_tables_stay_smaller_than_the_texts(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(200)]
    texts = [" ".join(r.choice(words) for _ in range(300)) for _ in range(300)]  # nearly all three words in a row differ
    df = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "f long, text string").repartition(2).cache()
    begin, peak, plain = held(), [0], kneser_ney.lean

    def lean(x):
        out = plain(x)
        peak[0] = max(peak[0], held() - begin)
        return out

    monkeypatch.setattr(kneser_ney, "lean", lean)
    out, name = kneser_ney.log_likelihood(df, df.select((1 - F.col("f")).alias("f"), "text"), 2)
    assert out.filter(F.col(name) < 0).count() == 300
    assert 0 < peak[0] < sum(map(len, texts)) // 2  # the keys of the trigrams alone took more


def test_parts_shards_and_copies_change_nothing(spark):
    r = random.Random(6)
    line = lambda n: " ".join(r.choice(["river", "stone", "old", "mill,", "the", "a-b"]) for _ in range(n))
    rows = [(k, k % 2, line(25)) for k in range(20)] + [(90, 0, "unseen, words"), (91, 1, ""), (92, 0, None)]
    df = spark.createDataFrame(rows + rows[:3], "id long, f long, text string")
    texts = df.filter("id < 15").select((1 - F.col("f")).alias("f"), "text")

    def run(**kw):
        out, name = kneser_ney.log_likelihood(df, texts, 2, **kw)
        got = out.select("id", "n_bytes", name).collect()
        assert len(got) == len(rows) + 3
        values = {}
        for i, n, x in got:
            assert n == len((next(t for k, _, t in rows if k == i) or "").encode())
            assert abs(values.setdefault(i, x) - x) < 1e-6
        return values

    one, many = run(parts=1), run(parts=3, batch=64, shard=2)
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-4 for k in one)
    assert one[91] == one[92] == 0 and one[90] < 0
