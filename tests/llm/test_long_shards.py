from pyspark.sql import functions as F
from quillrank.llm import training_order


def test_reading_inside_a_shard_of_more_than_2_20_slots(spark, tmp_path):
    path, n = str(tmp_path / "long"), (1 << 20) + 100
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), n).cast("binary").alias("ids"))
    assert training_order.materialise(rows, path, length=1, slots=1 << 21) == n
    assert training_order.read_slots(spark, path, start=n - 5).select("slot").count() == 5
