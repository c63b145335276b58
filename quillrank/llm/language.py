"""Language identification in two steps: family first, then one-versus-one inside the family.

A document is a vector of square roots of its hashed byte trigrams' shares, of length one. Linear
support vector machines, one for each family, tell the families apart; inside the winning family a
linear machine for each pair of languages votes, and margins decide between equal votes. Languages
without a known family are a family each. Fitted on a bounded sample of labelled rows (SAMPLE in
all, spread evenly over the languages, chosen by a hash of the id); every text is predicted whole.

Defined results: a text that is null or holds no letter is `und` with score 0; with no labelled
rows every text is. Rows with a null language or id aren't learned from. Repeated rows give
repeated results; extra columns stay, and result names that clash get underscores.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import annotate, chunks, table, utf8
from quillrank.llm.linear import bounded, grams, svm

BITS, SAMPLE = 11, 4000
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn pa gu mr ne ur si",
    "turkic": "tr az kk ky uz tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def vectors(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    h = grams(flat, 3, BITS)
    out = np.zeros((len(offs) - 1, 1 << BITS), np.float32)
    for d, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        if e - s > 2:
            out[d] = np.sqrt(np.bincount(h[s : e - 2], minlength=1 << BITS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(raw: np.ndarray) -> bool:
    if _LETTER[raw].any():
        return True
    return bool((raw > 127).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", errors="ignore"))


class Languages:
    def __init__(self, x: np.ndarray, lang: list[str]):
        names = np.array(lang, object)
        self.family = {n: _FAMILY_OF.get(n, "only " + n) for n in sorted(set(lang))}
        self.families = sorted(set(self.family.values()))
        of = np.array([self.family[n] for n in lang], object)
        self.step = [svm(x, np.where(of == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.members = {f: [n for n in self.family if self.family[n] == f] for f in self.families}
        self.pairs = {}
        for f, ns in self.members.items():
            for a, b in combinations(ns, 2):
                use = (names == a) | (names == b)
                self.pairs[a, b] = svm(x[use], np.where(names[use] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, sure = np.full(len(x), "und", object), np.zeros(len(x))
        if not self.families:
            return out, sure
        squash = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        margin = np.column_stack([x @ w[:-1] + w[-1] for w in self.step]) if self.step else np.ones((len(x), 1))
        best = margin.argmax(axis=1)
        for k, f in enumerate(self.families):
            at = np.flatnonzero(best == k)
            ns = self.members[f]
            votes, total = np.zeros((len(at), len(ns))), np.zeros((len(at), len(ns)))
            least = np.full((len(at), len(ns)), np.inf)
            for (i, a), (j, b) in combinations(enumerate(ns), 2):
                w = self.pairs[a, b]
                m = x[at] @ w[:-1] + w[-1]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                total[:, i] += m
                total[:, j] -= m
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            pick = (votes + 0.5 * np.tanh(total)).argmax(axis=1) if len(at) else np.zeros(0, int)
            out[at] = np.array(ns, object)[pick]
            inner = least[np.arange(len(at)), pick]
            sure[at] = squash(margin[at, k]) * np.where(np.isinf(inner), 1, squash(np.where(np.isinf(inner), 0, inner)))
        return out, sure


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Languages:
    """Fitted on the rows that `learn` allows and that have a language, an id and a text."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n = rows.agg(F.count_distinct("lang")).first()[0]
    few = bounded(rows, "id", F.col("lang"), max(20, sample // max(1, n)))

    def encode(batches):
        for batch in batches:
            flat, offs = utf8(batch.column("text"))
            blobs = []
            for i, j in chunks(offs):
                blobs += [v.tobytes() for v in vectors(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("lang"), pa.array(blobs, pa.binary())], names=["id", "lang", "v"])

    got = few.select("id", "text", "lang").mapInArrow(encode, "id long, lang string, v binary").toPandas().sort_values(["id", "lang"], kind="stable")
    x = np.array([np.frombuffer(v, np.float32) for v in got["v"]]).reshape(len(got), 1 << BITS)
    return Languages(x, list(got["lang"]))


def identify(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vector of fixed length a family and a pair

    def begin():
        m = shared.value

        def step(texts):
            flat, offs = utf8(texts)
            names, scores = [], []
            for i, j in chunks(offs):
                part, o = flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                out, sure = m.predict(vectors(part, o))
                for d in range(j - i):
                    if not has_letter(part[o[d] : o[d + 1]]):
                        out[d], sure[d] = "und", 0.0
                names += out.tolist()
                scores += sure.tolist()
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return step

    return annotate(docs, [text_col], [("lang_pred", "string"), ("score", "double")], begin)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs, ~held)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language": op10_language}
ORACLES: dict[str, str] = {}
