"""Index tables and logs as Parquet; documents of results as JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_log(events: DataFrame, path: str) -> None:
    """Adds corrections or observations; the writer commits whole files only."""
    events.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's rows; none if there is no log. Files that are no Parquet, left by a writer that died, are passed over."""
    from quillrank.sources.markdown import exists

    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def clear_log(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def edit_rules(rules: DataFrame, add: tuple[str, str] | None = None, remove: int | None = None) -> DataFrame:
    """Rules with one appended, or the one at a place removed and the rest renumbered."""
    if add is not None:
        last = rules.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos"))
        rules = rules.select("pos", "pattern", "skill").union(last.select("pos", F.lit(add[0]).alias("pattern"), F.lit(add[1]).alias("skill")))
    if remove is not None:
        rules = rules.filter(F.col("pos") != remove).withColumn("pos", F.when(F.col("pos") > remove, F.col("pos") - 1).otherwise(F.col("pos")))
    return rules


def json_responses(ranked: DataFrame) -> DataFrame:
    """(query_id, response): JSON of each query's results, scores to four places."""
    item = F.struct("rank", "name", F.round("score", 4).alias("score"))
    return ranked.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("response"))


def context_block(ranked: DataFrame) -> DataFrame:
    """(query_id, context): numbered lines with scores to three places."""
    line = F.struct("rank", F.format_string("%d. %s (%.3f)", F.col("rank"), F.col("name"), F.col("score")).alias("line"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("context"))


def write_report(report: dict, spark: SparkSession, path: str) -> None:
    """A result as indented JSON text."""
    import json

    spark.createDataFrame([(json.dumps(report, indent=2, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_lexicon(lexicon: dict, spark: SparkSession, path: str, most: int = 12) -> None:
    """Sorted features with at most twelve sorted terms each, as JSON lines."""
    rows = [(t, f, sorted(ks)[:most]) for t, fs in sorted(lexicon.items()) for f, ks in sorted(fs.items())]
    spark.createDataFrame(rows, "tier string, feature string, terms array<string>").coalesce(1).write.mode("overwrite").json(path)
