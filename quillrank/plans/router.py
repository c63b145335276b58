"""A router over one corpus: build once, answer batches of queries by any registered method."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import lexicon as L
from quillrank.functions import text as X
from quillrank.operators import bm25, feedback, fusion, graph, routing, vectors
from quillrank.plans import topology
from quillrank.sources import store
from quillrank.sources.tables import cut

#: Least hybrid score of an item that a description may be taken to mean.
CONFIDENT = 0.03

#: method name -> f(router, queries) -> (query_id, id, score)
METHODS: dict[str, Callable[[Router, DataFrame], DataFrame]] = {}


def register_method(name: str):
    def put(f):
        METHODS[name] = f
        return f

    return put


def lexicon_table(spark: SparkSession, lexicon: L.Lexicon) -> DataFrame:
    rows = [(t, f, list(ks)) for t in L.TIERS for f, ks in sorted(lexicon.get(t, {}).items())]
    return spark.createDataFrame(rows, "tier string, feature string, keywords array<string>")


class Router:
    """items: id, name, text (lower case), and optional columns; queries: query_id, query."""

    def __init__(self, items: DataFrame, lexicon: L.Lexicon, neighbours: int | None = None):
        if items.isEmpty():
            raise ValueError("no items")
        # The index is a set of written tables: every query batch reads them, none builds them again.
        postings = bm25.index(items, X.tokens(F.col("text")), bag=False)
        features = cut(L.long_features(items, lexicon))
        stats = cut(vectors.feature_stats(features, postings.n))
        rows = cut(vectors.item_vectors(features, stats))
        named = rows.select("id", F.concat_ws(":", "tier", "feature").alias("feature"), "w")
        k = neighbours or graph.neighbours_wanted(postings.n)
        near = cut(graph.feature_neighbours(named, k) if k < postings.n - 1 else graph.pair_cosines(named))
        whole = postings.postings.unionByName(postings.lengths.filter("dl < 1").select("id", F.lit(None).cast("string").alias("token"), F.lit(1).cast("long").alias("tf"), "dl"))
        self._hold({"items": items, "postings": whole, "features": features, "stats": stats, "vectors": rows, "edges": cut(graph.degree_normalise(near))}, lexicon, postings)

    def _hold(self, tables: dict[str, DataFrame], lexicon: L.Lexicon, postings: bm25.Postings) -> None:
        self._tables, self.lexicon, self.postings = tables, lexicon, postings
        self.items, self.features, self.stats, self.vectors, self.edges = (tables[k] for k in ("items", "features", "stats", "vectors", "edges"))

    def tables(self) -> dict[str, DataFrame]:
        return dict(self._tables)

    def save(self, path: str) -> None:
        """All tables of the index, and the lexicon, below path."""
        spark = self.items.sparkSession
        store.save_index(self._tables | {"lexicon": lexicon_table(spark, self.lexicon)}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Router:
        """The router that was saved below path; nothing is built again."""
        held = store.load_index(spark, path, ["items", "postings", "features", "stats", "vectors", "edges", "lexicon"])
        lexicon: L.Lexicon = {"broad": {}, "precise": {}}
        for r in held.pop("lexicon").orderBy("tier", "feature").collect():  # a row a feature
            lexicon[r["tier"]][r["feature"]] = list(r["keywords"])
        made = cls.__new__(cls)
        made._hold(held, lexicon, bm25.from_table(held["postings"]))
        return made

    def status(self) -> dict[str, int | float]:
        """Sizes of the index."""
        n = self.postings.n
        return {"items": n, "features": self.stats.count(), "edges": self.edges.count(), "density": graph.density(self.edges, n).first()["density"], "tokens": self.postings.df.count()}

    def query_features(self, queries: DataFrame) -> DataFrame:
        return L.long_features(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")), self.lexicon)

    def scores(self, queries: DataFrame, method: str) -> DataFrame:
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}; one of {sorted([*METHODS, 'hybrid'])}")
        return METHODS[method](self, queries)

    def rank(self, queries: DataFrame, k: int = 10, method: str = "hybrid", digits: int = 9, extra_ranks: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, name, score)."""
        if method == "hybrid":
            signals = {name: cut(self.scores(queries, method)) for name, method in (("bm25", "keyword"), ("cosine", "cosine"), ("graph", "graph_spread"))}
            found = fusion.hybrid(queries, self.items, signals, k, digits, extra_ranks)
        else:
            found = bm25.top_k(self.scores(queries, method), k, digits)
        return found.join(self.items.select("id", "name"), "id").select("query_id", "rank", "id", "name", "score")

    def query(self, queries: DataFrame, k: int = 10, method: str = "hybrid", rules: DataFrame | None = None, corrections: DataFrame | None = None, observations: DataFrame | None = None, now: datetime | None = None, body: bool = False, extra_ranks: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, name, score[, body]) with rules first; extra_ranks: an outside ranker's (query_id, name, rank from 0), a further signal of the hybrid method; the hybrid method's scores are adjusted by corrections, then re-ranked by observations."""
        wide = k if corrections is None and observations is None else max(10 * k, 100)
        extra = fusion.named_ranks(extra_ranks, self.items) if extra_ranks is not None else None
        found = self.rank(queries, wide, method, extra_ranks=extra).select("query_id", "rank", "name", "score")
        if method == "hybrid" and (corrections is not None or observations is not None):
            held = found.join(queries.select("query_id", X.query_hash(F.col("query")).alias("qhash")), "query_id").withColumnRenamed("name", "skill")
            if corrections is not None:
                now = now or datetime.now()
                held = feedback.adjust(held, feedback.error_book(corrections, now), now)
            if observations is not None:
                known = feedback.boosts(held.select("qhash").distinct(), feedback.trained_posteriors(observations))
                held = feedback.personalised_rank(held.select("query_id", "qhash", "skill", "score"), known)
            found = bm25.top_k(held.select("query_id", F.col("skill").alias("id"), "score"), k).withColumnRenamed("id", "name")
        if rules is not None:
            found = routing.with_rules(found, routing.rule_matches(queries, rules, self.items), k)
        if body:
            last = vectors.last_of_each(self.items.select("name", "id", *[F.col(c) for c in self.items.columns if c == "body"]), "name", "id").drop("id")
            found = found.join(last, "name", "left")
        return found.filter(F.col("rank") <= k)

    def best_names(self, descriptions: DataFrame, least: float = CONFIDENT) -> DataFrame:
        """(query_id, name, score) of the item that each description (query_id, description) leads to; none if its score is under `least`."""
        found = self.rank(descriptions.select("query_id", F.col("description").alias("query")), 1)
        return found.filter(F.col("score") >= least).select("query_id", "name", "score")

    def correct(self, queries: DataFrame, when: datetime, boost: float = 1.0, least: float = CONFIDENT) -> DataFrame:
        """Correction events for queries (query_id, query, description): the skill is the item that the description leads to; too uncertain ones make no event."""
        meant = self.best_names(queries.select("query_id", "description"), least)
        return feedback.correction(queries.join(meant, "query_id"), F.col("name"), when, boost)

    @staticmethod
    def learn(queries: DataFrame, when: datetime) -> tuple[DataFrame, DataFrame]:
        """(correction events, observation events) of queries (query, preferred): to be appended to both logs."""
        return feedback.correction(queries, F.col("preferred"), when), feedback.observation(queries, F.col("preferred"), when)

    def plan(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, pos, name, resolved): the hybrid's best items in the order of their dependencies."""
        chosen = self.rank(queries, k).select("query_id", "rank", "name", "score")
        return topology.plan(chosen, self.items, graph.typed_edges(self.items).filter("type = 'depends_on'").select("src", "dst"))

    def item(self, name: str) -> DataFrame:
        """The last item of a name; no row if there is none."""
        return self.items.filter(F.col("name") == name).orderBy(F.desc("id")).limit(1)


@register_method("keyword")
def _keyword(r: Router, queries: DataFrame) -> DataFrame:
    return bm25.scores(queries, r.postings, X.tokens(F.col("query")))


@register_method("cosine")
def _cosine(r: Router, queries: DataFrame) -> DataFrame:
    return vectors.cosine_scores(vectors.query_vectors(r.query_features(queries), r.stats), r.vectors)


@register_method("jaccard")
def _jaccard(r: Router, queries: DataFrame) -> DataFrame:
    return vectors.jaccard_scores(r.query_features(queries).withColumnRenamed("id", "query_id"), r.features)


@register_method("tfidf")
def _tfidf(r: Router, queries: DataFrame) -> DataFrame:
    return vectors.tfidf_scores(queries, r.items, X.ascii_words)


@register_method("graph_spread")
def _graph(r: Router, queries: DataFrame) -> DataFrame:
    return graph.spread_all(queries, cut(_jaccard(r, queries)), r.items, r.postings.n, r.edges)


@register_method("tensor")
def _tensor(r: Router, queries: DataFrame) -> DataFrame:
    from quillrank.operators import tensor

    return tensor.boosted(_cosine(r, queries), tensor.factors(vectors.category_tensor(r.features, tensor.categories(r.items.sparkSession)), r.items))
