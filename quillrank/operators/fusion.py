"""Hybrid ranking: reciprocal rank fusion of BM25, cosine and graph activation, with a no-signal gate.

Every item has a rank in every signal: items with a score first (score, then id), then the others
by id. The rank of an item without a score is n matched + its place among the unmatched, which
follows from its place in the corpus and a running count of matched ids before it; so only items
that match in some signal, and as many unmatched ones as could reach the result, are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF, GATE_COVERAGE, GATE_GAP, SPARSE, SPARSE_WEIGHT = 60, 0.05, 0.005, 0.20, 0.2
WEIGHTS = {"bm25": 1.0, "cosine": 1.0, "graph": 0.5}


def places(items: DataFrame, id_col: str = "id") -> tuple[DataFrame, int]:
    """(id, pos): place of each item in id order, from range partitions and their sizes, and the number of items."""
    ordered = items.select(F.col(id_col).alias("id")).distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    ordered = ordered.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}  # one row a partition
    n, steps = 0, []
    for p in sorted(sizes):
        steps.append((p, n))
        n += sizes[p]
    begins = items.sparkSession.createDataFrame(steps or [(0, 0)], "part int, begin long")
    return ordered.join(F.broadcast(begins), "part").select("id", (F.col("begin") + F.col("within")).alias("pos")), n


def gate(queries: DataFrame, bm25: DataFrame, cosine: DataFrame, n: int) -> DataFrame:
    """(query_id, coverage, gap, passed): a query with hardly any BM25 match and no leading cosine has no result."""
    covered = bm25.filter("score > 0").groupBy("query_id").agg(F.count("*").alias("m"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = cosine.withColumn("_p", place).filter("_p <= 2").groupBy("query_id").agg(F.max("score").alias("one"), F.sum(F.when(F.col("_p") == 2, F.col("score"))).alias("two"))
    out = queries.select("query_id").join(covered, "query_id", "left").join(best, "query_id", "left")
    out = out.select("query_id", (F.coalesce("m", F.lit(0)) / F.lit(float(max(n, 1)))).alias("coverage"), (F.coalesce("one", F.lit(0.0)) - F.coalesce("two", F.lit(0.0))).alias("gap"))
    return out.withColumn("passed", ~((F.col("coverage") < GATE_COVERAGE) & (F.lit(n) >= 2) & (F.col("gap") < GATE_GAP)))


def named_ranks(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, id, rank from 0) for hybrid's extra_ranks, of an outside ranker's answers (query_id, name, rank from 0): the first item of each name, unknown names left out."""
    ids = items.groupBy("name").agg(F.min("id").alias("id"))
    return answers.join(ids, "name").groupBy("query_id", "id").agg(F.min("rank").alias("rank"))


def hybrid(queries: DataFrame, items: DataFrame, signals: dict[str, DataFrame], k: int, digits: int = 9, extra_ranks: DataFrame | None = None) -> DataFrame:
    """(query_id, rank from 1, id, score). signals: bm25, cosine, graph as (query_id, id, score); extra_ranks: optional (query_id, id, rank from 0) of weight 1, unranked items count as last."""
    pos, n = places(items)
    if n == 1:
        only = pos.first()["id"]
        return queries.filter(F.lit(k > 0)).select("query_id", F.lit(1).alias("rank"), F.lit(only).alias("id"), F.lit(1.0).alias("score"))
    passed = gate(queries, signals["bm25"], signals["cosine"], n).filter("passed")
    names = list(signals)
    parts = [s.filter("score > 0").select("query_id", "id", *[(F.round("score", digits) if m == name else F.lit(None).cast("double")).alias(m) for m in names]) for name, s in signals.items()]
    hit = reduce(DataFrame.union, parts).groupBy("query_id", "id").agg(*[F.max(m).alias(m) for m in names]).join(pos, "id")
    count = hit.groupBy("query_id").agg(F.count("*").alias("c"), *[F.count(m).alias(f"n_{m}") for m in names])
    sized = passed.join(count, "query_id", "left").na.fill(0)
    # Unmatched items that could be among the k best have a place before k + number of matched ones.
    room = sized.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.col("c") + k))).alias("pos"))
    near = room.join(pos, "pos").join(hit.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "pos", *[F.lit(None).cast("double").alias(m) for m in names])
    frame = hit.select("query_id", "id", "pos", *names).unionByName(near).join(sized, "query_id")
    by_place = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(0.0)
    for m in names:
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(m).desc_nulls_last(), "id")) - 1
        before = F.coalesce(F.sum(F.col(m).isNotNull().cast("long")).over(by_place), F.lit(0))
        frame = frame.withColumn(f"r_{m}", F.when(F.col(m).isNotNull(), first).otherwise(F.col(f"n_{m}") + F.col("pos") - before))
        weight = F.when(F.col("coverage") < SPARSE, SPARSE_WEIGHT).otherwise(WEIGHTS[m]) if m == "bm25" else F.lit(WEIGHTS[m])
        total = total + weight / (RRF + F.col(f"r_{m}"))
    if extra_ranks is not None:
        frame = frame.join(extra_ranks.select("query_id", "id", F.col("rank").alias("r_x")), ["query_id", "id"], "left")
        total = total + 1.0 / (RRF + F.coalesce("r_x", F.lit(n)))
    scored = frame.withColumn("score", F.round(total, digits))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
