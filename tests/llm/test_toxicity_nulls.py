"""op4: a label that is null in one category still teaches the other."""

import random

from pyspark.sql import functions as F
from quillrank.llm import toxicity


def test_null_label_of_one_category_teaches_the_other(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    rows = [(i, " ".join([*(word() for _ in range(20)), *(["stupidfool"] * 2 if i % 2 else [])])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    made = toxicity.score(docs, toxicity.fit_chain(docs, labels))
    right = made.filter((F.col("p_toxic") >= 0.5) == (F.col("doc_id") % 2 == 1)).count()
    assert right >= 195
    assert (toxicity.SAMPLE, toxicity.FEATURES) == (2000, 2048)
