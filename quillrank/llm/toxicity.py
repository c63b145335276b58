"""Toxicity by a classifier chain.

The categories are predicted in turn. Each has a linear model over the byte 5-grams present in a
document; later models get the earlier categories' probabilities besides. In training those come
from models that have not seen the row (out-of-fold); in prediction from the models of all rows.
The chain is fitted on a bounded, documented sample of labelled rows (SAMPLE for each combination
of labels, chosen by a hash of the id) and predicts every document.

Defined results: a null or empty text has no 5-grams and gets probability 0 and no rejection.
Labels with a null id take no part, a null label none in its own category; with no labelled rows, or rows of one class only,
a category is predicted as that class's share. Texts are taken whole; repeated rows give repeated
results; extra columns stay, and result names that clash get underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import annotate, chunks, table, trim, utf8
from quillrank.llm.linear import bounded, grams, logistic

GRAM, BITS = 5, 20
#: Labelled rows for each combination of labels; features of a model; folds of the out-of-fold predictions.
SAMPLE, FEATURES, FOLDS = 2000, 2048, 3
#: Least log ratio of class shares of a feature: in long texts many weak ones would add up.
MARKED = 2.0
#: Category, label column, value that means it.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def present(flat: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every distinct 5-gram in the documents, or of those with keep[hash] >= 0, numbered by it."""
    h = grams(flat, GRAM, BITS)
    whole = np.ones(len(flat), bool)
    for k in range(1, GRAM):
        at = offs[1:] - k
        whole[at[at >= offs[:-1]]] = False
    if keep is not None:
        h = keep[h]
        whole &= h >= 0
    place = np.flatnonzero(whole)
    owner = np.searchsorted(offs, place, side="right") - 1
    code = np.unique(owner.astype(np.int64) << BITS | h[place])
    return code >> BITS, code & ((1 << BITS) - 1)


class Chain:
    """Models of the categories in order: (features, weights, weights of earlier probabilities, intercept)."""

    def __init__(self, names: list[str]):
        self.names, self.models, self.keep = names, [], np.full(1 << BITS, -1, np.int32)

    def fit(self, doc: np.ndarray, feature: np.ndarray, labels: np.ndarray) -> None:
        n, fold = len(labels), np.arange(len(labels)) % FOLDS
        earlier = np.zeros((n, 0), np.float32)
        chosen = []
        for k in range(len(self.names)):
            y, known = labels[:, k].astype(np.float32), labels[:, k] >= 0
            out = np.zeros(n, np.float32)
            for f in range(FOLDS):
                out[fold == f] = self._apply(self._one(doc, feature, y, earlier, known & (fold != f)), doc, feature, earlier)[fold == f]
            self.models.append(self._one(doc, feature, y, earlier, known))
            chosen.append(self.models[-1][0])
            earlier = np.column_stack([earlier, out])
        used = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        self.keep[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(self.models)), np.float32)
        for k, (f, w, _, _) in enumerate(self.models):
            self.table[self.keep[f], k] = w

    @staticmethod
    def _one(doc, feature, y, earlier, rows):
        none = np.zeros(0, np.int64)
        if not rows.any() or y[rows].min() == y[rows].max():
            share = float(np.clip(y[rows].mean() if rows.any() else 0.0, 1e-3, 1 - 1e-3))
            return none, np.zeros(0, np.float32), np.zeros(earlier.shape[1], np.float32), float(np.log(share / (1 - share)))
        seen = rows[doc]
        yes = np.bincount(feature[seen & (y[doc] > 0)], minlength=1 << BITS)
        no = np.bincount(feature[seen & (y[doc] == 0)], minlength=1 << BITS)
        n1, n0 = float((y[rows] > 0).sum()), float((y[rows] == 0).sum())
        # Features come scaled by their log ratio of class shares, so one that marks a class weighs more from the start.
        ratio = np.log((yes + 0.5) / (n1 + 1)) - np.log((no + 0.5) / (n0 + 1))
        z = (yes / n1 - no / n0) / np.sqrt((yes + no + 1) / (n1 + n0) * (1 / n1 + 1 / n0)) * np.where(np.abs(ratio) >= MARKED, np.minimum(np.abs(ratio), 3), 0)
        pick = np.sort(np.argsort(-np.abs(z), kind="stable")[:FEATURES])
        pick = pick[((yes + no)[pick] > 0) & (np.abs(ratio[pick]) >= MARKED)]
        scale = ratio[pick].astype(np.float32)
        x = Chain._dense(doc, feature, pick, scale, earlier, rows)
        w, b = logistic(x, y[rows])
        return pick, w[: len(pick)] * scale, w[len(pick) :], b

    @staticmethod
    def _dense(doc, feature, pick, scale, earlier, rows):
        """The scaled features and earlier probabilities of the rows, in one matrix without copies."""
        number = np.full(1 << BITS, -1, np.int32)
        number[pick] = np.arange(len(pick))
        place = np.cumsum(rows) - 1
        use = np.flatnonzero((number[feature] >= 0) & rows[doc])
        at = number[feature[use]]
        x = np.zeros((int(rows.sum()), len(pick) + earlier.shape[1]), np.float32)
        x[place[doc[use]], at] = scale[at]
        x[:, len(pick) :] = earlier[rows]
        return x

    @staticmethod
    def _apply(model, doc, feature, earlier):
        pick, w, v, b = model
        value = np.zeros(1 << BITS, np.float32)
        value[pick] = w
        return 1 / (1 + np.exp(-np.clip(np.bincount(doc, value[feature], len(earlier)) + earlier @ v + b, -30, 30)))

    def predict(self, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, number = present(flat, offs, self.keep)
        n = len(offs) - 1
        out = np.zeros((n, len(self.models)))
        for k, (_, _, v, b) in enumerate(self.models):
            score = np.bincount(doc, self.table[number, k], n) if len(doc) else np.zeros(n)
            out[:, k] = 1 / (1 + np.exp(-np.clip(score + out[:, :k] @ v + b, -30, 30)))
        out[np.diff(offs) == 0] = 0
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain=CHAIN, sample: int = SAMPLE) -> Chain:
    """The chain fitted on at most about `sample` labelled rows for each combination of labels."""
    full = labels.filter(F.col(id_col).isNotNull())
    full = full.filter(F.coalesce(*[F.col(c).cast("string") for _, c, _ in chain]).isNotNull())
    # -1: no label in this category.
    marks = [F.coalesce((F.col(c) == v).cast("int"), F.lit(-1)).alias(f"y{k}") for k, (_, c, v) in enumerate(chain)]
    full = full.select(F.col(id_col).alias("id"), *marks)
    combination = F.concat_ws(" ", *[f"y{k}" for k in range(len(chain))])
    few = bounded(full, "id", combination, sample)
    ys = [f"y{k}" for k in range(len(chain))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few.select("id", *ys)), "id")  # at most about `sample` rows a combination

    def features(batches):
        for batch in batches:
            flat, offs = utf8(batch.column("text"))
            blobs = []
            for i, j in chunks(offs):
                doc, f = present(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                blobs += [f[s:e].astype(np.int32).tobytes() for s, e in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), *[batch.column(y) for y in ys], pa.array(blobs, pa.binary())], names=["id", *ys, "f"])

    got = rows.mapInArrow(features, "id long, " + ", ".join(f"{y} int" for y in ys) + ", f binary").toArrow().sort_by("id")
    y = np.column_stack([got.column(c).to_numpy() for c in ys])
    flat, ends = utf8(got.column("f"))
    feature, size = flat.view(np.int32), np.diff(ends) // 4
    made = Chain([c[0] for c in chain])
    made.fit(np.repeat(np.arange(len(size), dtype=np.int32), size), feature, y)
    trim()
    return made


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with one probability for each category, named p_<category>."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES weights a category and a fixed table

    def begin():
        model = shared.value

        def step(texts):
            flat, offs = utf8(texts)
            parts = [model.predict(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(model.names)))
            return [pa.array(p[:, k]) for k in range(p.shape[1])]

        return step

    return annotate(docs, [text_col], [(f"p_{n}", "double") for n in chain.names], begin)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: float = 0.5) -> DataFrame:
    """docs without those whose last category's probability reaches the bound; same columns."""
    made = score(docs, fit_chain(docs, labels, id_col, text_col), text_col)
    return made.filter(F.col(made.columns[-1]) < bound).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = score(docs, fit_chain(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
