"""Training of op1 in parts: the same model, and no table of the way there left on disk."""

import random

from quillrank.llm import common, kneser_ney


def test_parts_make_one_model_and_leave_nothing_else(spark):
    r = random.Random(8)
    texts = spark.createDataFrame([(k % 2, " ".join(r.choice(["river", "stone", "old", "mill,", "the"]) for _ in range(25))) for k in range(20)], "f long, text string")

    def merged(parts):
        before = len(common._written)
        model, left, spell = kneser_ney.train_words(texts, 2, parts)
        rows = {}
        for x in model.collect():
            p, rest = rows.get(x["key"], (None, None))
            assert p is None or x["p"] is None
            rows[x["key"]] = (x["p"] if p is None else p, x["rest"] if rest is None else rest)
        return rows, left, len(common._written) - before

    one, left1, n1 = merged(1)
    three, left3, n3 = merged(3)
    assert left1 == left3 and one.keys() == three.keys()
    for key, (p, rest) in one.items():
        for a, b in ((p, three[key][0]), (rest, three[key][1])):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-5)
    assert n1 == n3 == 3  # the model and two byte models
