"""Retrieval evaluation, diagnosis of misses, comparison of items, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reciprocal_ranks(queries: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, first, rr, hit): queries (query_id, expected array of names) against ranked (query_id, rank, name)."""
    want = queries.select("query_id", F.explode("expected").alias("name")).distinct()
    found = ranked.filter(F.col("rank") <= k).join(want, ["query_id", "name"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", "first", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.col("first").isNotNull().alias("hit"))


def mrr_hit(queries: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """One row: queries, MRR, Hit@k; zeros on no queries."""
    return reciprocal_ranks(queries, ranked, k).agg(F.count("*").alias("queries"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit"))


def diagnose(queries: DataFrame, ranked: DataFrame, query_features: DataFrame, item_features: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, name, shared, item_only, diluted) of expected items that are not among the k best."""
    want = queries.select("query_id", F.explode("expected").alias("name")).distinct()
    miss = want.join(ranked.filter(F.col("rank") <= k).select("query_id", "name"), ["query_id", "name"], "left_anti")
    none = F.array().cast("array<string>")
    sets = lambda df, key, out: df.groupBy(key).agg(F.array_sort(F.collect_set("feature")).alias(out))
    held = miss.join(sets(query_features, "query_id", "q"), "query_id", "left").join(sets(item_features, "name", "x"), "name", "left").select("query_id", "name", F.coalesce("q", none).alias("q"), F.coalesce("x", none).alias("x"))
    shared, only = F.array_intersect("x", "q"), F.array_except("x", "q")
    return held.select("query_id", "name", shared.alias("shared"), only.alias("item_only"), (F.size(only) > 3 * F.size(shared)).alias("diluted"))


def compare(query_features: DataFrame, item_features: DataFrame, names: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, name, score, jaccard, shared, known): named items against each query, best first; score 0 outside the k best."""
    none = F.array().cast("array<string>")
    q = query_features.groupBy("query_id").agg(F.collect_set("feature").alias("q"))
    x = item_features.groupBy("name").agg(F.collect_set("feature").alias("x"))
    asked = names.select("query_id", "name").distinct().join(q, "query_id", "left").join(x, "name", "left")
    asked = asked.join(ranked.filter(F.col("rank") <= k).select("query_id", "name", "score"), ["query_id", "name"], "left")
    a, b = F.coalesce("q", none), F.coalesce("x", none)
    jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return asked.select("query_id", "name", F.coalesce("score", F.lit(0.0)).alias("score"), jaccard.alias("jaccard"), F.array_sort(F.array_intersect(a, b)).alias("shared"), F.col("x").isNotNull().alias("known")).orderBy(F.desc("score"), "query_id", "name")


def self_test_sample(items: DataFrame, most: int | None = 20, length: int = 80) -> DataFrame:
    """Queries made of items' own descriptions: `most` items (None: all) in the order of a hash, so the sample is the same every time."""
    held = items.filter(F.length(F.coalesce("description", F.lit(""))) > 0)
    if most is not None:
        held = held.orderBy(F.xxhash64("name"), "name").limit(most)
    return held.select(F.col("name").alias("query_id"), F.substring("description", 1, length).alias("query"), F.array("name").alias("expected"))


def self_test(samples: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: queries, hit1 (expected first), misses (expected not among the first three)."""
    best = reciprocal_ranks(samples, ranked, 3)
    return best.agg(F.count("*").alias("queries"), F.coalesce(F.sum((F.col("first") == 1).cast("long")), F.lit(0)).alias("hit1"), F.coalesce(F.sum((~F.col("hit")).cast("long")), F.lit(0)).alias("misses"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, version: str, slack: float = 0.1) -> DataFrame:
    """(key, change): added, removed, or changed where the version moved by more than `slack`."""
    a, b = before.select(F.col(key), F.col(version).alias("_a")), after.select(F.col(key), F.col(version).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.abs(F.col("_a") - F.col("_b")) > slack, "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).filter("change is not null")
