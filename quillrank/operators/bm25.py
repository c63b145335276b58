"""BM25 over postings, for many queries at once.

`Postings` holds what a corpus needs once: postings, lengths, document frequencies, totals. Two
kinds exist: with sets of tokens (binary term frequency) and with bags (true term frequency).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import text as X
from quillrank.sources.tables import cut, small


@dataclass
class Postings:
    postings: DataFrame  # id, token, tf, dl
    lengths: DataFrame  # id, dl
    df: DataFrame  # token, df
    n: int
    avgdl: float


def index(items: DataFrame, tokens: Column, id_col: str = "id", bag: bool = True) -> Postings:
    """Postings of items, written once; tokens is an array column, repeated tokens count as often as they occur (bag=False: there are none, and no shuffle is needed)."""
    held = items.select(F.col(id_col).alias("id"), tokens.alias("tokens")).select("id", F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("token"))
    postings = held.groupBy("id", "dl", "token").agg(F.count("*").alias("tf")) if bag else held.withColumn("tf", F.lit(1).cast("long"))
    return from_table(cut(postings.select("id", "token", "tf", "dl")))


def from_table(held: DataFrame) -> Postings:
    """Postings of a written table (id, token, tf, dl); items without tokens stand there with a null one."""
    lengths = held.select("id", "dl").distinct()
    postings = held.filter("token is not null")
    row = lengths.agg(F.count("*").alias("n"), F.avg(F.greatest("dl", F.lit(0))).alias("a")).first()
    return Postings(postings, lengths, postings.groupBy("token").agg(F.count("*").alias("df")), row["n"], row["a"] or 0.0)


def scores(queries: DataFrame, corpus: Postings, query_tokens: Column, query_id: str = "query_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every item that shares a token with a query; repeated query tokens count once.

    The queries' tokens are broadcast if they are few, so postings stay where they are and the tokens of one item are added up before anything is shuffled.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(query_tokens)).alias("token"))
    idf = F.log((F.lit(corpus.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    wanted = corpus.df.join(small(q.select("token").distinct()), "token", "left_semi")
    weighted = q.join(wanted, "token").select("query_id", "token", idf.alias("idf"))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(max(corpus.avgdl, 1.0)))
    hits = corpus.postings.join(small(weighted), "token")
    return hits.groupBy("query_id", "id").agg(F.sum(F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def keyword_scores(queries: DataFrame, items: DataFrame, query_id: str = "query_id", query_text: str = "query", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """BM25 on token sets."""
    return scores(queries, index(items, X.tokens(F.col(text_col)), id_col, bag=False), X.tokens(F.col(query_text)), query_id)


def boosted_index(items: DataFrame, name: Column, body: Column, terms: list[str] = (), id_col: str = "id") -> Postings:
    """Postings of token bags in which the name's tokens count once more."""
    return index(items, F.concat(X.keyword_tokens(body, terms), X.keyword_tokens(name, terms)), id_col)


def boosted_from(queries: DataFrame, corpus: Postings, terms: list[str] = (), query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    return scores(queries, corpus, X.keyword_tokens(F.col(query_text), terms), query_id).filter("score > 0")


def boosted_scores(queries: DataFrame, items: DataFrame, name: Column, body: Column, terms: list[str] = (), query_id: str = "query_id", query_text: str = "query", id_col: str = "id") -> DataFrame:
    """BM25 on token bags in which the name's tokens count once more."""
    return boosted_from(queries, boosted_index(items, name, body, terms, id_col), terms, query_id, query_text)


def rerank_candidates(scored: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, rank, id, name, score): the items that an outside ranker is to order; its answer goes into `fusion.named_ranks`."""
    return top_k(scored, most).join(items.select("id", "name"), "id").select("query_id", "rank", "id", "name", "score")


def top_k(scored: DataFrame, k: int, digits: int | None = None, keep_all: bool = False) -> DataFrame:
    """(query_id, rank from 1, id, score): the k best of each query, ties to the smaller id."""
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
