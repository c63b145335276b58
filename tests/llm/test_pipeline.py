"""The pipeline's stages against their operators' definitions on a small table."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    other = "one day the river rose above all its banks and carried away the wooden bridge near our old stone mill"
    rows = [(1, long, "en", "a", 1), (2, long, "en", "a", 1), (3, other + ". And so on it went, for weeks and weeks.", "en", "b", 1), (4, "Then: " + other, "en", "b", 1), (5, "item words here are thirteen long so that a single window is made of them", "en", "c", 1), (6, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[4][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r["doc_id"]: r["decoded"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {1: long, 3: rows[2][1], 4: "Then: ", 6: ""}
    assert docs.filter(F.col("doc_id") == 2).count() == 1
