"""Rankings in NumPy passes over the items against those from tables of (query, item) pairs."""

import random

import pytest
from pyspark.sql import functions as F
from quillrank import catalog
from quillrank.functions import text as X
from quillrank.operators import blocks, bm25, vectors
from quillrank.sources import tables

WORDS = ["".join(p) for p in zip("abcdefghij" * 4, "klmnopqrst" * 4, "uvwxyzabcd" * 2 + "efghijklmn" * 2)]


def corpus(spark, n=300, kind="long", seed=4):
    r = random.Random(seed)
    make = lambda: " ".join(r.choice(WORDS[: r.choice([6, 40])]) for _ in range(r.randrange(1, 12)))
    texts = [make() for _ in range(n - 40)]
    texts += texts[:30] + [None, "", "é !"] + [make() for _ in range(7)]
    r.shuffle(texts)
    ids = list(range(n))
    r.shuffle(ids)
    items = spark.createDataFrame([(i if kind == "long" else f"d{i}", t) for i, t in zip(ids, texts)] + [(None, "ak bl ak")], f"id {kind}, text string").repartition(3)
    asked = spark.createDataFrame([(i, make()) for i in range(9)] + [(20, None), (21, "zz"), (22, "ak ak bl")], "query_id int, query string")
    return items, asked


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tfidf_blocks_match_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(blocks, "ITEMS", 16)
    items, asked = corpus(spark, kind=kind)
    want = bm25.top_k(vectors.tfidf_scores(asked, items, X.ascii_words, max_terms=20), 7, 6)
    got = blocks.tfidf_top(asked, items, X.ascii_words, 7, 6, max_terms=20, block=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert blocks.tfidf_top(asked, items.filter("false"), X.ascii_words, 7, 6).count() == 0
    assert blocks.tfidf_top(asked.filter("false"), items, X.ascii_words, 7, 6).columns == ["query_id", "rank", "id", "score"]


def test_tfidf_topk_writes_no_postings_and_shuffles_no_pairs(spark):
    before = len(tables._written)
    got = catalog.tfidf_topk(spark, "/root/testdata/sf0.001")
    assert len(tables._written) == before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hybrid_blocks_match_pairs(spark, kind, monkeypatch):
    from quillrank.functions import lexicon as L
    from quillrank.operators import fusion, hybrid

    monkeypatch.setattr(blocks, "ITEMS", 16)
    items, asked = corpus(spark, n=400, kind=kind)
    items = items.filter("id is not null")
    lexicon = {"broad": {"x": ["ak", "bl"], "y": ["cm "]}, "precise": {"z": ["\\bdn"], "y": ["eo"], "none": ["qqq"]}}
    f = L.long_features(items, lexicon)
    s = vectors.feature_stats(f, items.count())
    qf = L.long_features(asked.select(F.col("query_id").alias("id"), F.col("query").alias("text")), lexicon)
    signals = {
        "bm25": bm25.scores(asked, bm25.index(items, X.ascii_tokens(F.col("text")), bag=False), X.ascii_tokens(F.col("query"))),
        "cosine": vectors.cosine_scores(vectors.query_vectors(qf, s), vectors.item_vectors(f, s)),
        "graph": vectors.jaccard_scores(qf.withColumnRenamed("id", "query_id"), f),
    }
    want = sorted(map(tuple, fusion.hybrid(asked, items, signals, 5).collect()))
    got = sorted(map(tuple, hybrid.hybrid_top(asked, items, X.ascii_tokens, lexicon, 5, block=5).collect()))
    assert got == want and len(got) >= 40
    assert hybrid.depth(5, 9, 400) < 400  # items that lead no signal are never looked at again
    assert hybrid.hybrid_top(asked, items.filter("false"), X.ascii_tokens, lexicon, 5).count() == 0
    assert {r["score"] for r in hybrid.hybrid_top(asked, items.limit(1), X.ascii_tokens, lexicon, 5).collect()} == {1.0}


def test_rrf_hybrid_writes_no_pairs(spark):
    before = len(tables._written)
    catalog.rrf_hybrid(spark, "/root/testdata/sf0.001").count()
    written = [spark.read.parquet(p).columns for p in tables._written[before:]]
    assert written == [["id", "dl", "at", "shape"], ["q", "s", "id", "b", "c", "j"]]
