"""Corrections that decay, observations, posterior counts, personalised re-ranking.

Both states are event logs; the books that scores are adjusted with are aggregates of the logs.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import decayed, query_hash

STEP, PRUNE_DAYS, UNSEEN, KNOWN_BASE = 0.012, 30, 0.5, 0.3


def error_book(corrections: DataFrame, now: datetime, prune_days: int = PRUNE_DAYS) -> DataFrame:
    """(qhash, skill, boost, ts): summed boosts; ts is the query's latest correction, and queries older than the bound are dropped."""
    latest = corrections.groupBy("qhash").agg(F.max("ts").alias("ts")).filter(F.col("ts") >= F.lit(now) - F.expr(f"interval {int(prune_days)} days"))
    return corrections.groupBy("qhash", "skill").agg(F.sum("boost").alias("boost")).join(latest, "qhash")


def adjust(scored: DataFrame, book: DataFrame, now: datetime, half_life_days: float = 7.0) -> DataFrame:
    """Scores (qhash, skill, score, ...) with 0.012 of the decayed boost added."""
    boosts = book.select("qhash", "skill", decayed(F.col("boost"), F.col("ts"), F.lit(now), half_life_days).alias("_b"))
    return scored.join(boosts, ["qhash", "skill"], "left").withColumn("score", F.col("score") + STEP * F.coalesce("_b", F.lit(0.0))).drop("_b")


def book_stats(book: DataFrame, now: datetime, half_life_days: float = 7.0) -> DataFrame:
    """One row: queries, sum of decayed boosts, boosts over 0.1."""
    b = decayed(F.col("boost"), F.col("ts"), F.lit(now), half_life_days)
    return book.agg(F.count_distinct("qhash").alias("entries"), F.coalesce(F.sum(b), F.lit(0.0)).alias("total_boost"), F.coalesce(F.sum((b > 0.1).cast("long")), F.lit(0)).alias("active"))


def live_posteriors(observations: DataFrame) -> DataFrame:
    """(qhash, skill, alpha, beta): alpha is 1 + own weights; beta is 1 + a fifth of the others' weights since the skill was first seen.

    Running sums by query: what came after a skill's first sight is the total less the sum up to it, and the skill's own share of that.
    """
    upto = Window.partitionBy("qhash").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = observations.groupBy("qhash", "skill", "seq").agg(F.sum("weight").alias("weight"))
    rows = rows.withColumn("run", F.sum("weight").over(upto))
    per = rows.groupBy("qhash", "skill").agg(F.sum("weight").alias("own"), F.min_by(F.struct("run", "weight"), "seq").alias("at"))
    total = rows.groupBy("qhash").agg(F.sum("weight").alias("total"))
    against = F.col("total") - F.col("at.run") - (F.col("own") - F.col("at.weight"))
    return per.join(total, "qhash").select("qhash", "skill", (1.0 + F.col("own")).alias("alpha"), (1.0 + 0.2 * against).alias("beta"))


def correction(queries: DataFrame, preferred, ts, boost: float = 1.0) -> DataFrame:
    """Events (qhash, skill, boost, ts) for the correction log: queries (query, and what `preferred` needs) should have led to a skill."""
    return queries.select(query_hash(F.col("query")).alias("qhash"), preferred.alias("skill"), F.lit(float(boost)).alias("boost"), F.lit(ts).cast("timestamp").alias("ts"))


def observation(queries: DataFrame, skill, ts, weight: int = 1) -> DataFrame:
    """Events (qhash, skill, weight, seq) for the observation log; seq is the time in microseconds, so later appends come later."""
    return queries.select(query_hash(F.col("query")).alias("qhash"), skill.alias("skill"), F.lit(int(weight)).alias("weight"), F.unix_micros(F.lit(ts).cast("timestamp")).alias("seq"))


def prune(corrections: DataFrame, now: datetime, days: int = PRUNE_DAYS) -> DataFrame:
    """The log without queries whose latest correction is older than the bound."""
    live = corrections.groupBy("qhash").agg(F.max("ts").alias("_last")).filter(F.col("_last") >= F.lit(now) - F.expr(f"interval {int(days)} days"))
    return corrections.join(live, "qhash", "left_semi")


def observation_stats(observations: DataFrame) -> DataFrame:
    """One row: distinct queries, sum of weights, distinct (query, skill) pairs."""
    return observations.agg(F.count_distinct("qhash").alias("queries"), F.coalesce(F.sum("weight"), F.lit(0)).alias("observations"), F.count_distinct("qhash", "skill").alias("pairs"))


def trained_posteriors(observations: DataFrame) -> DataFrame:
    """(qhash, skill, alpha, beta) from counts alone."""
    return observations.groupBy("qhash", "skill").agg((1.0 + F.sum("weight")).alias("alpha")).withColumn("beta", F.lit(1.0))


def boosts(queries: DataFrame, posteriors: DataFrame, seed: int | None = None) -> DataFrame:
    """(qhash, skill, boost in 0.3..1) of observed pairs: the posterior's mean, or a seeded sample. Skills not observed under a known hash have 0.3, all skills under an unknown hash 0.5."""
    held = posteriors.join(queries.select("qhash").distinct(), "qhash", "left_semi")
    if seed is None:
        value = F.col("alpha") / (F.col("alpha") + F.col("beta"))
        return held.select("qhash", "skill", F.greatest(F.lit(0.3), F.least(F.lit(1.0), value)).alias("boost"))

    @F.pandas_udf("double")
    def sample(key: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
        import numpy as np

        # One generator a row, seeded by its key, so the sample doesn't depend on the partitions.
        return pd.Series([np.random.default_rng([seed, k & 0xFFFFFFFFFFFFFFFF]).beta(a, b) for k, a, b in zip(key, alpha, beta)]).clip(0.3, 1.0)

    return held.select("qhash", "skill", sample(F.xxhash64("qhash", "skill"), "alpha", "beta").alias("boost"))


def personalised_rank(scored: DataFrame, known: DataFrame) -> DataFrame:
    """scored (query_id, qhash, skill, score) re-ranked: each place moves by the boost, the more so the wider the query's boosts are spread."""
    has = known.select("qhash").distinct().withColumn("_known", F.lit(True))
    joined = scored.join(known, ["qhash", "skill"], "left").join(has, "qhash", "left")
    joined = joined.withColumn("boost", F.coalesce("boost", F.when(F.col("_known"), KNOWN_BASE).otherwise(UNSEEN)))
    spread = joined.groupBy("query_id").agg((F.max("boost") - F.min("boost")).alias("_spread"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "skill")) - 1
    moved = joined.withColumn("place", place).join(spread, "query_id")
    factor = F.greatest(F.lit(0.01), 1 - (0.15 + 0.85 * F.col("_spread")) * (F.col("boost") - 0.5))
    return moved.withColumn("score", 1.0 / (60 + F.col("place") * factor)).select("query_id", "qhash", "skill", "score", "boost")


def cooccurrence(observations: DataFrame) -> DataFrame:
    """(a, b, w): skills by the queries they share, 1 + log(1 + count) per query, rows scaled to length one."""
    m = observations.groupBy("qhash", "skill").agg((1 + F.log1p(F.sum("weight"))).alias("m"))
    pairs = m.select("qhash", F.col("skill").alias("a"), F.col("m").alias("x")).join(m.select("qhash", F.col("skill").alias("b"), F.col("m").alias("y")), "qhash")
    w = pairs.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("w"))
    norm = w.groupBy("a").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return w.join(norm, "a").select("a", "b", (F.col("w") / F.when(F.col("n") < 1e-10, 1.0).otherwise(F.col("n"))).alias("w"))


def als_factors(observations: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Query and skill factors of implicit alternating least squares over 1 + log(1 + count)."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.recommendation import ALS

    m = observations.groupBy("qhash", "skill").agg((1 + F.log1p(F.sum("weight"))).alias("rating"))
    m = StringIndexer(inputCols=["qhash", "skill"], outputCols=["u", "i"], stringOrderType="alphabetAsc").fit(m).transform(m).withColumn("u", F.col("u").cast("int")).withColumn("i", F.col("i").cast("int"))
    n = m.select("skill").distinct().count()
    model = ALS(implicitPrefs=True, rank=min(64, max(4, n // 2)), regParam=0.1, maxIter=15, seed=seed, userCol="u", itemCol="i", ratingCol="rating").fit(m)
    users, skills = m.select("qhash", F.col("u").alias("id")).distinct(), m.select("skill", F.col("i").alias("id")).distinct()
    return model.userFactors.join(users, "id").select("qhash", "features"), model.itemFactors.join(skills, "id").select("skill", "features")
