"""Category tensor (domain, language, action), its CP decomposition, and scores boosted by it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Features of each category.
CATEGORIES = {
    0: ("security", "frontend", "backend", "database", "devops", "network", "mobile", "desktop", "data", "ml", "document", "feishu", "firecrawl", "design"),
    1: ("python", "javascript_ts", "react_specific", "go", "rust", "java", "kotlin", "swift", "dart_flutter", "php", "csharp", "cpp", "harmonyos", "shell"),
    2: ("code_quality", "testing", "build_fix", "security_scan", "performance", "architect", "planning", "tdd_testing", "refactor_clean", "e2e", "documentation"),
}
RIDGE, SEED = 1e-6, 42


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, c) for c, fs in CATEGORIES.items() for f in fs], "feature string, cat int")


def _row_factors(cells: DataFrame, row: str, other: str, left: DataFrame, third: np.ndarray, rank: int) -> DataFrame:
    """(id, f): least-squares rows of one long mode: sums over the cells, then a solve of rank x rank."""
    gram = left.select(*[F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"g{i}_{j}") for i in range(rank) for j in range(rank)])
    g = np.array(gram.first(), float).reshape(rank, rank) * (third.T @ third)
    inv = np.linalg.pinv(g + RIDGE * np.eye(rank))
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in third])
    joined = cells.join(left.withColumnRenamed("id", other), other)
    sums = joined.groupBy(row).agg(*[F.sum(F.col("val") * F.col("f")[k] * F.element_at(weights, F.col("cat") + 1)[k]).alias(f"m{k}") for k in range(rank)])
    solved = F.array(*[sum((F.col(f"m{i}") * float(inv[i, k]) for i in range(rank)), F.lit(0.0)) for k in range(rank)])
    return sums.select(F.col(row).alias("id"), solved.alias("f"))


def factors(cells: DataFrame, items: DataFrame, rank: int = 8, rounds: int = 6, seed: int = SEED, n_cat: int = 3) -> DataFrame:
    """(id, f array<double>): rows of the first mode of a seeded CP decomposition by alternating least squares; the long modes stay distributed, the 3 x rank one is on the driver."""
    from quillrank.sources.tables import cut

    cells = cut(cells)
    b = items.select("id", F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda k: (F.xxhash64("id", k, F.lit(seed)) % 1000003) / 1000003.0).alias("f"))
    c = np.random.default_rng(seed).normal(size=(n_cat, rank))
    a = b
    for _ in range(rounds):
        a = cut(_row_factors(cells, "i", "j", b, c, rank))
        b = cut(_row_factors(cells, "j", "i", a, c, rank))
        both = cells.join(a.select(F.col("id").alias("i"), F.col("f").alias("fa")), "i").join(b.select(F.col("id").alias("j"), F.col("f").alias("fb")), "j")
        sums = both.groupBy("cat").agg(*[F.sum(F.col("val") * F.col("fa")[k] * F.col("fb")[k]).alias(f"m{k}") for k in range(rank)]).collect()  # a row a category
        grams = []
        for df in (a, b):
            grams.append(np.array(df.select(*[F.coalesce(F.sum(F.col("f")[i] * F.col("f")[j]), F.lit(0.0)) for i in range(rank) for j in range(rank)]).first(), float).reshape(rank, rank))
        inv = np.linalg.pinv(grams[0] * grams[1] + RIDGE * np.eye(rank))
        c = np.zeros((n_cat, rank))
        for r in sums:
            c[r["cat"]] = np.array([r[f"m{k}"] for k in range(rank)]) @ inv
    return a


def boosted(base: DataFrame, held: DataFrame, best: int = 30, least: float = 0.05, alike: float = 0.3, share: float = 0.25) -> DataFrame:
    """base (query_id, id, score) plus, for each of a query's best items, a share of its score for every item with a like factor row."""
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))
    unit = held.withColumn("n", norm).filter("n > 1e-10").select("id", F.transform("f", lambda x: x / F.col("n")).alias("u"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = base.withColumn("_p", place).filter((F.col("_p") <= best) & (F.col("score") > least)).drop("_p")
    cos = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # Like rows share the factor that weighs most in one of them: pairs meet on factors that are large enough in both.
    heavy = lambda c: F.explode(F.filter(F.transform(c, lambda x, i: F.when(F.abs(x) >= alike / F.size(c), i)), lambda i: i.isNotNull()))
    a = top.select("id").distinct().join(unit, "id").select(F.col("id").alias("a"), F.col("u").alias("ua"), heavy(F.col("u")).alias("k"))
    b = unit.select(F.col("id").alias("b"), F.col("u").alias("ub"), heavy(F.col("u")).alias("k"))
    sims = a.join(b, "k").filter("a <> b").select("a", "b", F.abs(cos).alias("s")).distinct().filter(F.col("s") > alike)
    more = top.join(sims, top["id"] == sims["a"]).groupBy("query_id", F.col("b").alias("id")).agg((F.sum(F.col("score") * F.col("s")) * share).alias("more"))
    return base.join(more, ["query_id", "id"], "full_outer").select("query_id", "id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"))
