"""Bounds of op1: all trusted documents calibrate, and short texts don't set the bounds of long ones."""

import random

from quillrank.llm import kneser_ney


def test_bounds_by_length_from_all_trusted(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(20)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    # Sixty very short trusted texts of unknown words set the loose upper end of all lengths together.
    rows = [(i, line(80), "en") for i in range(200)] + [(1000 + i, "".join(r.choice("uvwxyz") for _ in range(5)), "en") for i in range(60)]
    rows += [(2000 + i, " ".join("".join(r.choice("ijklmn") for _ in range(3)) if k % 2 else r.choice(words) for k in range(92)), "en") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in kneser_ney.quality(df, df.filter("doc_id < 2000").select("doc_id")).collect()}
    assert not any(got[2000 + i]["keep"] for i in range(10))
    assert got[0]["high"] < got[1000]["high"]
    # Bounds are values of trusted documents of that length, wherever they were dealt.
    long = [got[i]["perplexity"] for i in range(200)]
    assert got[0]["low"] == min(long) and sum(got[i]["keep"] for i in range(200)) >= 195
