"""Exact search for the highest inner products with two cover trees.

Vectors become integers, floor(64 x). Queries and candidates are each indexed in a cover tree:
a node at a level covers its points within the level's radius, its children's centres are picked
greedily among them at a smaller radius, and the first child keeps the parent's centre; a node of
few points is a leaf, and points that no well-filled child covers are leaves of their own. Two trees are searched together: the inner product of any query and any
candidate below a pair of nodes is at most q.c + |q| rc + |c| rq + rq rc for centres q, c and
covering radii rq, rc, and the pair is dropped if that is under the worst kth score held for the
queries of the query node. Leaves that meet are bounded for each query by itself, q.c + |q| rc,
before products are made. Equal bounds stay, so ties go to the smaller id. How much this prunes is a
matter of the vectors: clustered ones are pruned well, directions spread evenly over many dimensions
not at all (see the README).

The queries (a stated set) are dealt into blocks by a hash of the id and written; one block after
another goes over all candidates: the block is broadcast, candidates stream through as Arrow
batches, a task keeps its best scores from batch to batch, and a block's results are written
before the next one starts, so neither a plan nor a task grows with the number of blocks.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id. Vectors of different lengths do not meet: a query's candidates are the
vectors of its own length (none: no row). Equal vectors under different ids are different candidates; a candidate
with the query's own id is left out. Products are exact: by doubles below 2^53, by 64-bit integers
below 2^62, by integers of any size beyond; a score that no long can hold is given as the largest or
smallest long, and such scores tie. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.common import shared_dir, table, written

SCALE, K, EVERY = 64, 20, 20
#: Points in a leaf; candidates in one tree; queries in one block, about.
LEAF, TREE, BLOCK = 128, 8192, 16384
NONE, NOBODY = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Candidates of the most promising leaves that a query leaf looks at in one go.
WIDE = 1024
#: A level's radius over the next one's, and most children of a node: in many dimensions distances are alike, and halving would leave single points.
BASE, CHILDREN = 1.25, 24


class CoverTree:
    """Nodes in parallel lists: centre, covering radius, its points as a run of `order`, children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        n = len(x)
        self.order = np.arange(n)
        self.center, self.radius, self.run, self.children = [], [], [], []
        if n:
            dist = np.sqrt(np.maximum(((x - x[0]) ** 2).sum(axis=1), 0))
            self._grow(0, n, 0, dist, leaf)
        self.centers = x[self.center] if n else x
        self.radii, self.norms = np.array(self.radius), np.linalg.norm(self.centers, axis=1)
        self.inner = np.array([bool(c) for c in self.children])

    def _grow(self, s: int, e: int, c: int, dist: np.ndarray, leaf: int) -> int:
        """A node over order[s:e] around point c; dist: of those points to c."""
        node = len(self.center)
        far = float(dist.max())
        self.center.append(c)
        self.radius.append(far)
        self.run.append((s, e))
        self.children.append([])
        if e - s <= leaf or far == 0 or not np.isfinite(far):  # distances beyond doubles are not told apart
            return node
        left, near, bound = self.order[s:e].copy(), dist, far / BASE
        at, first = s, True
        rest = []
        while len(left) and len(self.children[node]) + len(rest) < CHILDREN:
            if not first:
                c = left[0]
                near = np.sqrt(np.maximum(((self.x[left] - self.x[c]) ** 2).sum(axis=1), 0))
            mine = near <= bound
            group, reach = left[mine], near[mine]
            left, near = left[~mine], near[~mine]
            first = False
            if len(group) < leaf // 8:
                rest.append(group)
                continue
            self.order[at : at + len(group)] = group
            self.children[node].append(self._grow(at, at + len(group), c, reach, leaf))
            at += len(group)
        # Points that no well-filled child covers: leaves around their nearest common centre, the node's own.
        rest = np.concatenate([*rest, left]) if rest or len(left) else left
        if len(rest):
            own = self.center[node]
            away = np.sqrt(((self.x[rest] - self.x[own]) ** 2).sum(axis=1))
            by = np.argsort(away, kind="stable")
            rest, away = rest[by], away[by]
            self.order[at:e] = rest
            for i in range(0, len(rest), leaf):
                part = away[i : i + leaf]
                self.children[node].append(len(self.center))
                self.center.append(own)
                self.radius.append(float(part.max()))
                self.run.append((at + i, min(at + i + leaf, e)))
                self.children.append([])
        return node


class Search:
    """Top-k state of a block of queries of one length, fed with batches of candidates. products: inner products made, of `possible` ones."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.tree, self.ids, self.x, self.k = CoverTree(x), ids, x, k
        self.most = float(np.abs(x).sum(axis=1).max(initial=0))
        self.scores = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), NOBODY)
        self.products = self.possible = 0

    def feed(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.possible += len(ids) * len(self.ids)
        if not len(ids) or not len(self.ids):
            return
        most = float(np.abs(x).max(initial=0))
        # How products stay exact.
        self.kind = np.float64 if self.most * most < 2**53 else np.int64 if max(self.most * most, self.most, most) < 2**62 else object
        if self.kind is object:  # bounds in doubles could overflow: block against block
            for r in range(0, len(self.ids), 64):
                for c in range(0, len(ids), WIDE):
                    self._leaf(np.arange(r, min(r + 64, len(self.ids))), np.arange(c, min(c + WIDE, len(ids))), x, ids)
            return
        self._visit(0, CoverTree(x), ids, np.zeros(1, np.int64))

    def _products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.products += len(a) * len(b)
        if self.kind is np.float64:
            return (a @ b.T).astype(np.int64)
        if self.kind is np.int64:
            return a.astype(np.int64) @ b.astype(np.int64).T
        whole = np.vectorize(int, otypes=[object])
        big = whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)
        # The smallest long stands for "none", so clipped scores end one above it.
        return np.minimum(np.maximum(big, NONE + 1), NOBODY).astype(np.int64)

    def _bounds(self, q: int, t: CoverTree, nodes: np.ndarray) -> np.ndarray:
        rq, nq, r, norm = self.tree.radii[q], self.tree.norms[q], t.radii[nodes], t.norms[nodes]
        bounds = t.centers[nodes] @ self.tree.centers[q] + nq * r + norm * rq + rq * r + 1e-6 * (1 + norm * nq)
        return np.where(np.isnan(bounds), np.inf, bounds)

    def _visit(self, q: int, t: CoverTree, ids: np.ndarray, nodes: np.ndarray) -> None:
        """The queries below q against the candidates below `nodes`; the wider of both sides is opened next."""
        s, e = self.tree.run[q]
        rows = self.tree.order[s:e]
        while True:
            bounds = self._bounds(q, t, nodes)
            keep = bounds >= self.scores[rows, -1].min()
            nodes, bounds = nodes[keep], bounds[keep]
            if not len(nodes):
                return
            inner = t.inner[nodes]
            if self.tree.children[q] and (not inner.any() or self.tree.radii[q] >= t.radii[nodes[inner]].max()):
                for child in self.tree.children[q]:
                    self._visit(child, t, ids, nodes)
                return
            if not inner.any():
                break
            nodes = np.concatenate([nodes[~inner], *[np.array(t.children[i]) for i in nodes[inner]]])
        self._leaves(rows, t, ids, nodes[np.argsort(-bounds, kind="stable")])

    def _leaves(self, rows: np.ndarray, t: CoverTree, ids: np.ndarray, nodes: np.ndarray) -> None:
        """A query leaf against candidate leaves, with a bound for each query by itself."""
        x = self.x[rows]
        norm = np.linalg.norm(x, axis=1)[:, None]
        bound = x @ t.centers[nodes].T + norm * t.radii[nodes] + 1e-6 * (1 + norm * t.norms[nodes])
        bound[np.isnan(bound)] = np.inf
        points = [t.order[slice(*t.run[i])] for i in nodes]
        todo = np.ones(bound.shape, bool)
        if (self.scores[rows, -1] == NONE).any():  # each query's most promising leaf first
            first = bound.argmax(axis=1)
            for n in np.unique(first):
                self._leaf(rows[first == n], points[n], t.x, ids)
            todo[np.arange(len(rows)), first] = False
        size = np.cumsum([len(p) for p in points])
        for part in np.split(np.arange(len(nodes)), np.searchsorted(size, np.arange(WIDE, size[-1], WIDE))):
            open_ = todo[:, part] & (bound[:, part] >= self.scores[rows, -1][:, None])
            some = open_.any(axis=1)
            if not some.any():
                continue
            if todo[:, part].all() and open_.mean() > 0.5:
                self._leaf(rows[some], np.concatenate([points[n] for n in part]), t.x, ids)
                continue
            for n, col in zip(part, open_.T):
                if col.any():
                    self._leaf(rows[col], points[n], t.x, ids)

    def _leaf(self, rows: np.ndarray, at: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """All products of some queries and candidates; those that reach a query's kth score are merged into its best."""
        score = self._products(self.x[rows], x[at])
        score[ids[at][None, :] == self.ids[rows][:, None]] = NONE
        bound = self.scores[rows, -1]
        if score.shape[1] > self.k:
            bound = np.maximum(bound, np.partition(score, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((score >= bound[:, None]) & (score > NONE))
        some = np.unique(r)
        if not len(some):
            return
        row = np.concatenate([np.repeat(some, self.k), r])
        value = np.concatenate([self.scores[rows[some]].ravel(), score[r, c]])
        who = np.concatenate([self.found[rows[some]].ravel(), ids[at[c]]])
        order = np.lexsort((who, ~value, row))
        row = row[order]
        seat = np.arange(len(row)) - np.searchsorted(row, row)
        take = order[seat < self.k]
        self.scores[rows[some]] = value[take].reshape(-1, self.k)
        self.found[rows[some]] = who[take].reshape(-1, self.k)


def quantise(vectors: pa.Array, ids: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (ids, integer vectors as doubles) of the rows that take part."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors, ids = vectors.combine_chunks(), ids.combine_chunks()
    rows = np.flatnonzero(~(vectors.is_null().to_numpy(zero_copy_only=False) | ids.is_null().to_numpy(zero_copy_only=False)))
    vectors, ids = vectors.take(pa.array(rows)), ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components: nan
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    out = {}
    for width in np.unique(size).tolist():
        ok = size == width
        x = np.floor(flat[np.repeat(ok, size)].reshape(-1, width) * SCALE) if width else np.zeros((int(ok.sum()), 0))
        good = np.isfinite(x).all(axis=1)
        out[width] = (ids[ok][good], x[good])
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query."""
    spark = queries.sparkSession
    shape = "query_id long, vec_id long, score long"
    live = queries.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    asked = live.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    blocks = -(-asked.count() // block)
    asked = written(asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))).repartition("b"))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], shape).write.parquet(path)
    for b in range(blocks):
        rows = asked.filter(F.col("b") == b).select("id", "v").toArrow()  # about `block` rows
        held = quantise(rows.column("v"), rows.column("id"))
        del rows
        shared = spark.sparkContext.broadcast(held)

        def search(batches, shared=shared):
            states = {w: Search(ids, x, k) for w, (ids, x) in shared.value.items() if len(ids)}
            waiting: dict[int, list] = {w: [] for w in states}

            def flush(w):
                if waiting[w]:
                    ids, x = zip(*waiting[w])
                    waiting[w] = []
                    states[w].feed(np.concatenate(ids), np.concatenate(x))

            for batch in batches:
                for s in range(0, batch.num_rows, TREE):
                    for w, (cid, cx) in quantise(batch.column(1).slice(s, TREE), batch.column(0).slice(s, TREE)).items():
                        if w in states:
                            waiting[w].append((cid, cx))
                            if sum(len(i) for i, _ in waiting[w]) >= TREE:
                                flush(w)
            for w, state in states.items():
                flush(w)
                row, col = np.nonzero(state.found != NOBODY)
                yield pa.RecordBatch.from_arrays([pa.array(state.ids[row]), pa.array(state.found[row, col]), pa.array(state.scores[row, col])], names=["query_id", "vec_id", "score"])

        found = candidates.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(search, shape)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.withColumn("rank", best).filter(F.col("rank") <= k).drop("rank").write.mode("append").parquet(path)
        shared.unpersist()
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spark.read.schema(shape).parquet(path).withColumn("rank", best).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return top_k(rows.filter(F.col("vec_id") % EVERY == 0), rows)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

QUERIES = {"op7_topk_search": op7_topk_search}
ORACLES = {"op7_topk_search": SQL}
