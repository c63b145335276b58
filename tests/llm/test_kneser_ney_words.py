"""The word model of op1 against its definition, and what it must tell apart."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from quillrank.llm import kneser_ney
from quillrank.llm.common import utf8


def split(text):
    flat, offs = utf8(pa.array([text]))
    _, starts, lens, _ = kneser_ney.tokens(flat, offs)
    return [text.encode()[s : s + n] for s, n in zip(starts, lens)]


def brute(train, spell):
    """log P(w | u, v) straight from the counts, which is interpolated modified Kneser-Ney."""
    c3 = Counter(tuple(g) for t in train for w in [["", "", *split(t)]] for g in zip(w, w[1:], w[2:]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter((w,) for _, w in c2)

    def level(c):
        n = Counter(c.values())
        n1, n2, n3, n4 = (max(n[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), top) for x, top in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95), (3 - 4 * y * n4 / n3, 2.95))]
        total, left = defaultdict(int), defaultdict(float)
        for g, k in c.items():
            total[g[:-1]] += k
            left[g[:-1]] += d[min(k, 3) - 1]
        return c, d, total, left

    levels = [level(c) for c in (c1, c2, c3)]

    def p(g):
        if not g:
            raise ValueError
        c, d, total, left = levels[len(g) - 1]
        lower = p(g[1:]) if len(g) > 1 else math.exp(spell(g[0]))
        if not total[g[:-1]]:
            return lower
        k = c[g]
        return max(k - d[min(k, 3) - 1], 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * lower if k else left[g[:-1]] / total[g[:-1]] * lower

    return lambda t: sum(math.log(p(g)) for w in [["", "", *split(t)]] for g in zip(w, w[1:], w[2:]))


def test_tokens_make_up_the_text():
    assert split("It's  so, é 1") == [b"It", b"'", b"s", b" ", b" so", b",", " é".encode(), b" 1"]


def test_word_model_matches_definition(spark):
    r = random.Random(5)
    make = lambda n: " ".join(r.choice(["river", "stone", "old", "mill", "and,", "the"]) for _ in range(n))
    train = [make(30) for _ in range(12)] + ["", "x"]
    score = [make(20), train[0], "unseen words, the mill", "", "river river river", "é" * 50]
    texts = spark.createDataFrame([(0, t) for t in train], "f long, text string")
    docs = spark.createDataFrame([(0, t, t) for t in score] + [(0, None, None)], "f long, text string, name string")
    out, name = kneser_ney.log_likelihood(docs, texts, batch=64, shard=7)
    got = {x["name"]: x[name] for x in out.collect()}
    model, left, spell = kneser_ney.train_words(texts)
    shard = next(kneser_ney.shards_of(spell[0]))

    def spelt(token):
        raw = np.frombuffer(token + kneser_ney.END, np.uint8)
        return float(shard.sums(raw, np.array([0, len(raw)]))[0])

    want = brute(train, spelt)
    for t in score:
        assert abs(got[t] - want(t)) < 1e-4 * max(1, abs(want(t))), t
    assert got[None] == 0


def test_repeated_words_are_junk_and_counts_grow_with_the_corpus(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    follows = {w: r.sample(vocabulary, 3) for w in vocabulary}

    def walk(n):
        w = [r.choice(vocabulary)]
        while len(w) < n:
            w.append(r.choice(follows[w[-1]]))
        return " ".join(w)

    rows = [(i, walk(60), "en") for i in range(400)] + [(500 + k, " ".join([w] * 60), "en") for k, w in enumerate(vocabulary[:10])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["keep"] for x in kneser_ney.quality(df, df.filter("doc_id < 300").select("doc_id")).collect()}
    assert not any(got[500 + k] for k in range(10) if vocabulary[k] not in follows[vocabulary[k]])
    assert sum(got[i] for i in range(400)) >= 360

    sizes = [kneser_ney.count_words(df.filter(F.col("doc_id") < n).select(F.lit(0).cast("long").alias("f"), F.concat_ws(" ", F.col("doc_id").cast("string"), "text").alias("text"))).count() for n in (100, 400)]
    assert sizes[1] > 1.5 * sizes[0]
