"""Feature vectors in long form, their similarities, and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.bm25 import index
from quillrank.sources.tables import small

PRECISE_WEIGHT = 1.5


def feature_stats(features: DataFrame, n_items: int) -> DataFrame:
    """(tier, feature, df, coverage, ig): document frequency, share of items, and the weight that rare features get."""
    return features.groupBy("tier", "feature").agg(F.count_distinct("id").alias("df")).withColumn("coverage", F.col("df") / F.lit(max(n_items, 1))).withColumn("ig", 0.3 + 1.5 * (1 - F.col("coverage")))


def item_vectors(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, tier, feature, w): tier weight times rarity weight."""
    tier = F.when(F.col("tier") == "precise", PRECISE_WEIGHT).otherwise(1.0)
    return features.join(stats.select("tier", "feature", "ig"), ["tier", "feature"]).select("id", "tier", "feature", (tier * F.col("ig")).alias("w"))


def query_vectors(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, tier, feature, w) without rarity weights; features that no item has are left out."""
    tier = F.when(F.col("tier") == "precise", PRECISE_WEIGHT).otherwise(1.0)
    return features.join(stats.select("tier", "feature"), ["tier", "feature"], "left_semi").select(F.col("id").alias("query_id"), "tier", "feature", tier.alias("w"))


def cosine_scores(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, id, score) of item and query vectors that share a feature."""
    qn = queries.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    xn = items.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("xn"))
    # Features are few: with the queries broadcast, items stay where they are instead of meeting on a feature.
    dots = items.join(small(queries.withColumnRenamed("w", "qw")), ["tier", "feature"]).groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(qn, "query_id").join(xn, "id").select("query_id", "id", (F.col("dot") / (F.col("xn") * F.col("qn") + 1e-10)).alias("score"))


def jaccard_scores(queries: DataFrame, items: DataFrame, indexed: bool = True) -> DataFrame:
    """(query_id, id, score). indexed: (tier, feature) columns of the index count, others of the query don't; else names, tiers collapsed, and all of the query's count."""
    key = ["tier", "feature"] if indexed else ["feature"]
    q, x = queries.select("query_id", *key).distinct(), items.select("id", *key).distinct()
    if indexed:
        q = q.join(x.select(*key).distinct(), key, "left_semi")
    nq, nx = q.groupBy("query_id").agg(F.count("*").alias("nq")), x.groupBy("id").agg(F.count("*").alias("nx"))
    inter = x.join(small(q), key).groupBy("query_id", "id").agg(F.count("*").alias("inter"))
    return inter.join(nq, "query_id").join(nx, "id").select("query_id", "id", (F.col("inter") / (F.col("nq") + F.col("nx") - F.col("inter"))).alias("score"))


def diagnostics(features: DataFrame, items: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: features on over 80 % of the items, items with under two features, items with none."""
    per = items.select("id").join(features.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    high = stats.agg(F.coalesce(F.sum((F.col("coverage") > 0.8).cast("long")), F.lit(0)).alias("high_coverage"))
    low = per.agg(F.coalesce(F.sum((F.col("n") < 2).cast("long")), F.lit(0)).alias("low_features"), F.coalesce(F.sum((F.col("n") == 0).cast("long")), F.lit(0)).alias("no_features"))
    return high.join(low)  # one row each


def tfidf_scores(queries: DataFrame, items: DataFrame, tokens, query_id: str = "query_id", query_text: str = "query", id_col: str = "id", text_col: str = "text", max_terms: int = 5000) -> DataFrame:
    """Cosine of TF-IDF vectors, log term frequency, smoothed idf. The collection of a query is the corpus and the query itself, so n and df are the query's own."""
    corpus = index(items, tokens(F.col(text_col)), id_col)
    cf = corpus.postings.groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    vocab = cf.orderBy(F.desc("cf"), "token").limit(max_terms).select("token", "df")
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf")).join(vocab, "token")
    n = corpus.n + 1
    idf = lambda df: F.log(F.lit(1.0 + n) / (1 + df)) + 1
    q = q.withColumn("qw", (1 + F.log("qtf")) * idf(F.col("df") + 1))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    x = corpus.postings.join(vocab, "token").withColumn("ltf", 1 + F.log("tf")).withColumn("w", F.col("ltf") * idf(F.col("df")))
    base = x.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    # Only tokens of the query have another df than in the corpus alone: their share of the norm is exchanged.
    hits = q.select("query_id", "token", "qw").join(x, "token").withColumn("own", F.col("ltf") * idf(F.col("df") + 1))
    sums = hits.groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("own")).alias("dot"), F.sum(F.col("own") * F.col("own") - F.col("w") * F.col("w")).alias("more"))
    return sums.join(base, "id").join(qn, "query_id").select("query_id", "id", (F.col("dot") / (F.col("qn") * F.sqrt(F.col("sq") + F.col("more")))).alias("score"))


def normalise(rows: DataFrame, score: str = "score", by: str | None = None) -> DataFrame:
    """rows with score scaled to 0..1 (0 where all are equal), over all rows or by a key; grouped bounds, no window over everything."""
    from quillrank.functions.text import min_max

    bounds = (rows.groupBy(by) if by else rows.groupBy()).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    joined = rows.join(bounds, by) if by else rows.join(F.broadcast(bounds))  # one row
    return joined.withColumn(score, min_max(F.col(score), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def category_tensor(features: DataFrame, categories: DataFrame) -> DataFrame:
    """(i, j, cat, val): Jaccard of the items' features of each category (feature, cat); an item with itself is 1."""
    x = features.select("id", "feature").distinct().join(categories, "feature").select("id", "cat", "feature")
    n = x.groupBy("id", "cat").agg(F.count("*").alias("n"))
    a, b = x.withColumnRenamed("id", "i"), x.withColumnRenamed("id", "j")
    inter = a.join(b, ["cat", "feature"]).filter("i <> j").groupBy("i", "j", "cat").agg(F.count("*").alias("c"))
    sized = inter.join(n.select(F.col("id").alias("i"), "cat", F.col("n").alias("ni")), ["i", "cat"]).join(n.select(F.col("id").alias("j"), "cat", F.col("n").alias("nj")), ["j", "cat"])
    return sized.select("i", "j", "cat", (F.col("c") / (F.col("ni") + F.col("nj") - F.col("c"))).alias("val"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_p", place).filter("_p = 1").drop("_p")
