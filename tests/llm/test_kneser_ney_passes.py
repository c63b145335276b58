"""CPU of op1: few passes over the texts, mails that name frequent tokens by numbers, look-ups that find what is there."""

import random

import numpy as np
from quillrank.llm import kneser_ney
from quillrank.llm.common import mix


def test_texts_are_read_a_few_times_only(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    r = random.Random(2)
    rows = [(k % 2, " ".join(r.choice(["river", "stone", "old", "mill,", "the"]) for _ in range(25))) for k in range(50)]
    df = spark.createDataFrame(rows, "f long, text string").repartition(1)
    texts = df.selectExpr("1 - f as f", "text").filter("length(text) > 0")
    out, name = kneser_ney.log_likelihood(df.mapInArrow(count, df.schema), texts, 2)
    assert out.filter(f"{name} < 0").count() == 50
    assert 50 * 5 < read.value <= 50 * 9  # before: 13 times


def test_letters_and_slots():
    t = mix(np.arange(1000, dtype=np.uint64))
    deal = kneser_ney.Deal(t[:300], np.arange(300, 0, -1), 5, 10)
    for width in (6, 8):
        c, back = kneser_ney.lettered(kneser_ney.letters(deal.code(t), t, width), deal, width)
        assert (back == (t if width == 8 else t & kneser_ney.LOW48)).all() and (c[300:] == kneser_ney.RARE).all()
    assert np.count_nonzero(deal.code(t[:300]) != kneser_ney.RARE) > 290
    assert not len(kneser_ney.lettered(kneser_ney.letters(deal.code(t[:0]), t[:0]), deal)[1])
    crowded = np.append(t, t[:50] ^ np.uint64(1))  # same high bits: one slot for two
    found = kneser_ney.Slots(crowded)
    assert (found.find(crowded) == np.arange(1050)).all() and (found.find(t + np.uint64(2)) == -1).all()
    assert (kneser_ney.Slots(t[:0]).find(t) == -1).all()
    assert len({*deal.part(deal.code(t), t, 3).tolist()}) == 3
