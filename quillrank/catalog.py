"""Registered queries of the ranking engine over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions import lexicon as L
from quillrank.functions import text as X
from quillrank.operators import blocks, bm25, discovery, evaluate, feedback, fusion, graph, hybrid, routing, vectors
from quillrank.plans import topology
from quillrank.sources.tables import cut, table

K = 10
#: A lexicon for the invented prose of the documents.
LEXICON: L.Lexicon = {
    "broad": {"english": [" the ", " of "], "german": ["ung ", "keit"], "french": ["eau", "que "], "spanish": ["ción", " los "]},
    "precise": {"noisy": ["$$$", "###", "!!"], "tables": [" | "], "ing": ["ing "], "ment": ["ment"], "api": ["\\bapi\\b"]},
}
CATEGORIES = [("english", 0), ("german", 0), ("french", 0), ("spanish", 0), ("noisy", 1), ("tables", 1), ("ing", 2), ("ment", 2)]
STOP = ["the", "and", "that", "with", "from", "this", "for", "was"]
RULES = [(0, "thing.*the", "alpha"), (1, r"\bof\b", "beta"), (2, "ing", "gamma"), (3, "e", "missing")]
TRIGGERS = [("the", "short", 0), ("tion", "longer", 1), ("thtion", "longest", 2), ("ment", "french", 3), (" ung", "german", 4)]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def talk(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 10000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def observed(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("qhash"), F.col("event_type").alias("skill"), F.lit(1).alias("weight"), F.col("event_id").alias("seq"), F.col("value").alias("boost"), "ts")


def lex_rows() -> str:
    return ", ".join(f"('{t}', '{f}', '{k.strip(chr(92) + 'b') if k.startswith(chr(92)) else k}', {str(k.startswith(chr(92))).lower()})" for t, fs in LEXICON.items() for f, ks in fs.items() for k in ks)


TOK = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]{{2,}}'))"
BAG = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]{{2,}}')"
FEATS = f"lexi(tier, feature, kw, rx) AS (VALUES {lex_rows()}), df AS (SELECT DISTINCT doc_id AS id, tier, feature FROM documents, lexi WHERE CASE WHEN rx THEN regexp_matches(lower(text), '\\b' || kw || '\\b') ELSE contains(lower(text), kw) END), qf AS (SELECT DISTINCT item_id AS query_id, tier, feature FROM benchmark, lexi WHERE CASE WHEN rx THEN regexp_matches(lower(text), '\\b' || kw || '\\b') ELSE contains(lower(text), kw) END)"
STATS = "n AS (SELECT count(*) AS n FROM documents), st AS (SELECT tier, feature, count(*) AS df, count(*) / (SELECT n FROM n)::DOUBLE AS coverage, 0.3::DOUBLE + 1.5::DOUBLE * (1 - count(*) / (SELECT n FROM n)::DOUBLE) AS ig FROM df GROUP BY 1, 2)"
VECS = "iv AS (SELECT id, tier, feature, (CASE WHEN tier = 'precise' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * ig AS w FROM df JOIN st USING (tier, feature)), qv AS (SELECT query_id, tier, feature, CASE WHEN tier = 'precise' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM qf SEMI JOIN st USING (tier, feature))"
COS = "cosi AS (SELECT query_id, id, dot / (xn * qn + 1e-10::DOUBLE) AS score FROM (SELECT query_id, id, sum(qv.w * iv.w) AS dot FROM qv JOIN iv USING (tier, feature) GROUP BY 1, 2) JOIN (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qv GROUP BY 1) USING (query_id) JOIN (SELECT id, sqrt(sum(w * w)) AS xn FROM iv GROUP BY 1) USING (id))"
BM = f"""p AS (SELECT doc_id AS id, unnest({TOK.format('text')}) AS token FROM documents), dl AS (SELECT doc_id AS id, len({TOK.format('text')}) AS dl FROM documents),
c AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), tdf AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS token FROM benchmark),
bm AS (SELECT query_id, id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(a, 1)))) AS score FROM q JOIN tdf USING (token) JOIN p USING (token) JOIN dl USING (id), c GROUP BY 1, 2)"""
TOP = "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(score, 6) AS score FROM {}{})) WHERE rank <= 10"


def _postings(spark, sf):
    return bm25.index(docs(spark, sf), X.ascii_tokens(F.col("text")), bag=False)


def _bm25(spark, sf):
    return bm25.scores(asked(spark, sf), _postings(spark, sf), X.ascii_tokens(F.col("query")))


@query(f"WITH {BM} {TOP.format('bm', '')}")
def bm25_topk(spark, sf):
    return bm25.top_k(_bm25(spark, sf), K, 6)


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def tokenize_ascii(spark, sf):
    t = X.ascii_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ").cast("binary")).alias("digest"))


@query("SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) <= 3))) AS t FROM documents)")
def tokenize_full(spark, sf):
    t = X.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ").cast("binary")).alias("digest"))


@query(f"WITH {BM} SELECT token, df FROM tdf")
def doc_freq(spark, sf):
    return _postings(spark, sf).df


@query(f"SELECT doc_id AS id, len({TOK.format('text')}) AS dl FROM documents")
def doc_length(spark, sf):
    return docs(spark, sf).select("id", F.size(X.ascii_tokens(F.col("text"))).cast("long").alias("dl"))


@query("SELECT conv_id, turn, substr(md5(CASE WHEN len(t) > 0 THEN array_to_string(t[1:5], ' ') ELSE substr(lower(coalesce(text, '')), 1, 30) END), 1, 12) AS qhash FROM (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}|[\\x{4e00}-\\x{9fff}]{2,4}') AS t FROM conversations)")
def query_hash(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.query_hash(F.col("text")).alias("qhash"))


@query(f"WITH {FEATS} SELECT * FROM df")
def lexicon_match(spark, sf):
    return L.long_features(docs(spark, sf), LEXICON)


def _stats(spark, sf):
    d = docs(spark, sf)
    f = _features(spark, sf)
    return d, f, vectors.feature_stats(f, d.count())


def _features(spark, sf):
    """Features of the documents, matched once."""
    return cut(L.long_features(docs(spark, sf), LEXICON))


@query(f"WITH {FEATS}, {STATS} SELECT tier, feature, df, round(coverage, 9) AS coverage, round(ig, 9) AS ig FROM st")
def feature_ig(spark, sf):
    return _stats(spark, sf)[2].select("tier", "feature", "df", F.round("coverage", 9).alias("coverage"), F.round("ig", 9).alias("ig"))


@query(f"WITH {FEATS}, {STATS}, per AS (SELECT doc_id, count(feature) AS n FROM documents LEFT JOIN df ON id = doc_id GROUP BY 1) SELECT (SELECT count(*) FROM st WHERE coverage > 0.8) AS high_coverage, count(*) FILTER (n < 2) AS low_features, count(*) FILTER (n = 0) AS no_features FROM per")
def feature_diag(spark, sf):
    d, f, s = _stats(spark, sf)
    return vectors.diagnostics(f, d, s)


def _qf(spark, sf):
    return L.long_features(asked(spark, sf).select(F.col("query_id").alias("id"), F.col("query").alias("text")), LEXICON)


def _cosine(spark, sf, f=None):
    f = f if f is not None else _features(spark, sf)
    s = vectors.feature_stats(f, docs(spark, sf).count())
    return vectors.cosine_scores(vectors.query_vectors(_qf(spark, sf), s), vectors.item_vectors(f, s))


def _jaccard(spark, sf, f=None, indexed=True):
    return vectors.jaccard_scores(_qf(spark, sf).withColumnRenamed("id", "query_id"), f if f is not None else _features(spark, sf), indexed)


@query(f"WITH {FEATS}, {STATS}, {VECS}, {COS} {TOP.format('cosi', '')}")
def cosine_topk(spark, sf):
    return bm25.top_k(_cosine(spark, sf), K, 6)


JAC = "jac AS (SELECT query_id, id, i / (nq + nx - i)::DOUBLE AS score FROM (SELECT query_id, id, count(*) AS i FROM qf JOIN df USING (tier, feature) GROUP BY 1, 2) JOIN (SELECT query_id, count(*) AS nq FROM qf SEMI JOIN df USING (tier, feature) GROUP BY 1) USING (query_id) JOIN (SELECT id, count(*) AS nx FROM df GROUP BY 1) USING (id))"


@query(f"WITH {FEATS}, {JAC} {TOP.format('jac', '')}")
def jaccard_topk(spark, sf):
    return bm25.top_k(_jaccard(spark, sf), K, 6)


@query(f"WITH {FEATS}, a AS (SELECT DISTINCT query_id, feature FROM qf), b AS (SELECT DISTINCT id, feature FROM df), j AS (SELECT query_id, id, i / (nq + nx - i)::DOUBLE AS score FROM (SELECT query_id, id, count(*) AS i FROM a JOIN b USING (feature) GROUP BY 1, 2) JOIN (SELECT query_id, count(*) AS nq FROM a GROUP BY 1) USING (query_id) JOIN (SELECT id, count(*) AS nx FROM b GROUP BY 1) USING (id)) {TOP.format('j', '')}")
def jaccard_names_topk(spark, sf):
    return bm25.top_k(_jaccard(spark, sf, indexed=False), K, 6)


@query(f"""WITH p AS (SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, unnest({BAG.format('text')}) AS token FROM documents) GROUP BY 1, 2),
v AS (SELECT token, count(*) AS df FROM p GROUP BY 1 ORDER BY sum(tf) DESC, token LIMIT 5000), n AS (SELECT count(*) + 1 AS n FROM documents),
q AS (SELECT query_id, token, df, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({BAG.format('text')}) AS token FROM benchmark) JOIN v USING (token) GROUP BY 1, 2, 3),
qs AS (SELECT DISTINCT query_id FROM q),
f AS (SELECT qs.query_id, p.id, p.token, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + v.df + (q.token IS NOT NULL)::INT)) + 1) AS w, (1 + ln(qtf)) * (ln((1 + n)::DOUBLE / (2 + v.df)) + 1) AS qw FROM p JOIN v USING (token) CROSS JOIN qs LEFT JOIN q ON q.query_id = qs.query_id AND q.token = p.token, n),
s AS (SELECT query_id, id, sum(w * qw) / sqrt(sum(w * w)) AS s FROM f GROUP BY 1, 2 HAVING sum(w * qw) IS NOT NULL),
qn AS (SELECT query_id, sqrt(sum(pow((1 + ln(qtf)) * (ln((1 + n)::DOUBLE / (2 + df)) + 1), 2))) AS qn FROM q, n GROUP BY 1),
r AS (SELECT query_id, id, s / qn AS score FROM s JOIN qn USING (query_id)) {TOP.format('r', '')}""")
def tfidf_topk(spark, sf):
    return blocks.tfidf_top(asked(spark, sf), docs(spark, sf), X.ascii_words, K, 6)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN hi - lo > 1e-10 THEN (l_extendedprice - lo) / (hi - lo) ELSE 0 END, 9) AS score FROM lineitem JOIN (SELECT l_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) USING (l_orderkey)")
def minmax_normalize(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"))
    return vectors.normalise(rows, by="l_orderkey").select("l_orderkey", "l_linenumber", F.round("score", 9).alias("score"))


KNN = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-10)) AS e FROM v),
c AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.e, b.e), 9) AS w FROM u a JOIN u b ON a.id <> b.id),
kn AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM c) WHERE r <= 5),
sy AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM kn UNION ALL SELECT dst, src, w FROM kn) GROUP BY 1, 2),
dg AS (SELECT src AS id, CASE WHEN sum(w) < 1e-10 THEN 1 ELSE sum(w) END AS d FROM sy GROUP BY 1),
gn AS (SELECT src, dst, w / sqrt(a.d * b.d) AS w FROM sy JOIN dg a ON a.id = src JOIN dg b ON b.id = dst)"""


def _knn(spark, sf):
    return graph.nearest_dense(table(spark, sf, "embeddings"), 5, "vec_id", "embedding")


@query(f"WITH {KNN} SELECT src, dst, round(w, 6) AS w FROM kn")
def knn_graph(spark, sf):
    return _knn(spark, sf).withColumn("w", F.round("w", 6))


@query(f"WITH {KNN} SELECT src, dst, round(w, 6) AS w FROM gn")
def graph_norm(spark, sf):
    return graph.degree_normalise(graph.symmetric(_knn(spark, sf))).withColumn("w", F.round("w", 6))


@query(f"WITH {KNN} SELECT round(count(*) FILTER (w > 0.01) / pow((SELECT count(*) FROM embeddings), 2), 9) AS density FROM gn")
def graph_density(spark, sf):
    n = table(spark, sf, "embeddings").count()
    return graph.density(graph.degree_normalise(graph.symmetric(_knn(spark, sf))), n).withColumn("density", F.round("density", 9))


@query(f"""WITH {KNN}, s AS (SELECT label AS query_id, vec_id AS id, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS score FROM embeddings),
a1 AS (SELECT query_id, dst AS id, sum(score * w) * 0.5 AS score FROM s JOIN gn ON id = src GROUP BY 1, 2), a2 AS (SELECT query_id, dst AS id, sum(score * w) * 0.25 AS score FROM a1 JOIN gn ON id = src GROUP BY 1, 2),
a3 AS (SELECT query_id, dst AS id, sum(score * w) * 0.125 AS score FROM a2 JOIN gn ON id = src GROUP BY 1, 2)
SELECT query_id, id, round(sum(score), 7) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) GROUP BY 1, 2""")
def graph_spread(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"))
    start = e.join(e.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").select("query_id", "id", (1.0 / F.col("n")).alias("score"))
    return graph.spread(start, graph.degree_normalise(graph.symmetric(_knn(spark, sf)))).withColumn("score", F.round("score", 7))


GATE = """cov AS (SELECT item_id AS query_id, coalesce(m, 0) / (SELECT count(*) FROM documents)::DOUBLE AS coverage, coalesce(one, 0) - coalesce(two, 0) AS gap FROM benchmark
LEFT JOIN (SELECT query_id, count(*) AS m FROM bm WHERE score > 0 GROUP BY 1) a ON a.query_id = item_id
LEFT JOIN (SELECT query_id, max(score) AS one, max(CASE WHEN r = 2 THEN score END) AS two FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM cosi) WHERE r <= 2 GROUP BY 1) b ON b.query_id = item_id),
gate AS (SELECT *, NOT (coverage < 0.05 AND gap < 0.005) AS passed FROM cov)"""


def _signals(spark, sf):
    """The three signals, each written: the gate and the fusion read them several times."""
    f = _features(spark, sf)
    return {"bm25": cut(_bm25(spark, sf)), "cosine": cut(_cosine(spark, sf, f)), "graph": cut(_jaccard(spark, sf, f))}


@query(f"WITH {BM}, {FEATS}, {STATS.replace('n AS (SELECT count(*) AS n FROM documents)', 'nn AS (SELECT 1)').replace('(SELECT n FROM n)', '(SELECT count(*) FROM documents)')}, {VECS}, {COS}, {GATE} SELECT query_id, round(coverage, 9) AS coverage, passed FROM gate")
def quality_gate(spark, sf):
    s = _signals(spark, sf)
    return fusion.gate(asked(spark, sf), s["bm25"], s["cosine"], docs(spark, sf).count()).select("query_id", F.round("coverage", 9).alias("coverage"), "passed")


@query(f"""WITH {BM}, {FEATS}, {STATS.replace('n AS (SELECT count(*) AS n FROM documents)', 'nn AS (SELECT 1)').replace('(SELECT n FROM n)', '(SELECT count(*) FROM documents)')}, {VECS}, {COS}, {JAC}, {GATE},
fr AS (SELECT g.query_id, d.doc_id AS id, coverage, coalesce(round(bm.score, 9), 0) AS b, coalesce(round(cosi.score, 9), 0) AS c, coalesce(round(jac.score, 9), 0) AS j FROM gate g CROSS JOIN documents d
LEFT JOIN bm ON bm.query_id = g.query_id AND bm.id = d.doc_id LEFT JOIN cosi ON cosi.query_id = g.query_id AND cosi.id = d.doc_id LEFT JOIN jac ON jac.query_id = g.query_id AND jac.id = d.doc_id WHERE passed),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) - 1 AS rb, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) - 1 AS rc, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, id) - 1 AS rj FROM fr),
s AS (SELECT query_id, id, round((CASE WHEN coverage < 0.2 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) / (60 + rb) + 1.0::DOUBLE / (60 + rc) + 0.5::DOUBLE / (60 + rj), 9) AS score FROM rk)
SELECT query_id, CAST(r AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10""")
def rrf_hybrid(spark, sf):
    return hybrid.hybrid_top(asked(spark, sf), docs(spark, sf), X.ascii_tokens, LEXICON, K).withColumn("score", F.round("score", 6))


@query("WITH r(pos, pattern, skill) AS (VALUES " + ", ".join(f"({p}, '{x}', '{s}')" for p, x, s in RULES if s != "missing") + ") SELECT conv_id * 10000 + turn AS query_id, arg_min(skill, pos) AS skill FROM conversations JOIN r ON regexp_matches(text, '(?i)' || pattern) WHERE role = 'user' GROUP BY 1")
def rule_override(spark, sf):
    rules = spark.createDataFrame(RULES, "pos int, pattern string, skill string")
    return routing.rule_matches(talk(spark, sf), rules, spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "name string"))


@query("WITH t(phrase, skill, ord) AS (VALUES " + ", ".join(f"('{p.strip()}', '{s}', {o})" for p, s, o in TRIGGERS) + ") SELECT query_id, skill FROM (SELECT conv_id * 10000 + turn AS query_id, skill, row_number() OVER (PARTITION BY conv_id, turn ORDER BY lower(trim(text)) = phrase DESC, length(phrase) DESC, ord) AS r FROM conversations JOIN t ON contains(lower(text), phrase) WHERE role = 'user') WHERE r = 1")
def trigger_match(spark, sf):
    return routing.trigger_matches(talk(spark, sf), spark.createDataFrame(TRIGGERS, "phrase string, skill string, ord int"))


@query("SELECT conv_id, turn, NOT (length(t) <= 1 OR regexp_full_match(t, '(?i)" + X.SMALL_TALK + "') OR regexp_full_match(t, '[\\x{1F300}-\\x{1F9FF}\\x{2700}-\\x{27BF}[:^word:]]+')) AS task FROM (SELECT *, lower(regexp_replace(trim(coalesce(text, '')), '[!！。，,.\\s]+$', '')) AS t FROM conversations)")
def task_gate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.is_task(F.col("text")).alias("task"))


OBS = "o AS (SELECT CAST(user_id AS VARCHAR) AS qhash, event_type AS skill, value AS boost, ts, event_id AS seq FROM events)"
BOOK = f"{OBS}, bk AS (SELECT qhash, skill, boost, l.ts FROM (SELECT qhash, skill, sum(boost) AS boost FROM o GROUP BY 1, 2) JOIN (SELECT qhash, max(ts) AS ts FROM o GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{{now}}' - INTERVAL 30 DAY) l USING (qhash)), dc AS (SELECT qhash, skill, boost * pow(0.5, (epoch(TIMESTAMP '{{now}}') - epoch(ts)) / 86400 / 7) AS b FROM bk)"


def _now(spark, sf):
    """The log's own end; a fixed date would prune everything or nothing."""
    return table(spark, sf, "events").agg(F.date_trunc("day", F.max("ts")).alias("m")).first()["m"]


_BOOK = BOOK.replace("TIMESTAMP '{now}'", "(SELECT date_trunc('day', max(ts)) FROM events)")


@query(f"WITH {_BOOK} SELECT qhash, skill, round(0.04 + 0.012 * coalesce(b, 0), 6) AS score FROM (SELECT DISTINCT qhash, skill FROM o) LEFT JOIN dc USING (qhash, skill)")
def error_book_adjust(spark, sf):
    o, now = observed(spark, sf), _now(spark, sf)
    base = o.select("qhash", "skill").distinct().withColumn("score", F.lit(0.04))
    return feedback.adjust(base, feedback.error_book(o, now), now).withColumn("score", F.round("score", 6))


@query(f"WITH {_BOOK} SELECT count(DISTINCT qhash) AS entries, round(coalesce(sum(b), 0), 4) AS total_boost, count(*) FILTER (b > 0.1) AS active FROM dc")
def error_book_stats(spark, sf):
    now = _now(spark, sf)
    return feedback.book_stats(feedback.error_book(observed(spark, sf), now), now).withColumn("total_boost", F.round("total_boost", 4))


@query(f"WITH {OBS} SELECT qhash, skill, 1.0::DOUBLE + count(*) AS alpha, 1.0::DOUBLE AS beta FROM o GROUP BY 1, 2")
def beta_priors(spark, sf):
    return feedback.trained_posteriors(observed(spark, sf)).withColumn("alpha", F.col("alpha").cast("double"))


@query(f"WITH {OBS}, f AS (SELECT qhash, skill, min(seq) AS f, count(*) AS n FROM o GROUP BY 1, 2) SELECT qhash, f.skill, 1.0::DOUBLE + n AS alpha, round(1 + 0.2::DOUBLE * (SELECT count(*) FROM o WHERE o.qhash = f.qhash AND o.seq > f.f AND o.skill <> f.skill), 6) AS beta FROM f")
def live_posteriors(spark, sf):
    p = feedback.live_posteriors(observed(spark, sf))
    return p.select("qhash", "skill", F.col("alpha").cast("double").alias("alpha"), F.round("beta", 6).cast("double").alias("beta"))


@query(f"""WITH {OBS}, b AS (SELECT qhash, skill, least(1, greatest(0.3::DOUBLE, (1.0::DOUBLE + count(*)) / (2.0::DOUBLE + count(*)))) AS boost, count(*) AS n, row_number() OVER (PARTITION BY qhash ORDER BY count(*) DESC, skill) - 1 AS place FROM o GROUP BY 1, 2)
SELECT qhash, skill, round(1 / (60 + place * greatest(0.01, 1 - (0.15 + 0.85 * (max(boost) OVER (PARTITION BY qhash) - min(boost) OVER (PARTITION BY qhash))) * (boost - 0.5))), 7) AS score FROM b""")
def personalised_rank(spark, sf):
    o = observed(spark, sf)
    scored = o.groupBy("qhash", "skill").agg(F.count("*").cast("double").alias("score")).withColumn("query_id", F.col("qhash"))
    known = feedback.boosts(o.select("qhash").distinct(), feedback.trained_posteriors(o))
    return feedback.personalised_rank(scored, known).select("qhash", "skill", F.round("score", 7).alias("score"))


@query(f"WITH {OBS}, m AS (SELECT qhash, skill, 1 + ln(1 + count(*)) AS m FROM o GROUP BY 1, 2), w AS (SELECT x.skill AS a, y.skill AS b, sum(x.m * y.m) AS w FROM m x JOIN m y USING (qhash) GROUP BY 1, 2) SELECT a, b, round(w / sqrt(sum(w * w) OVER (PARTITION BY a)), 7) AS w FROM w")
def cooccurrence_boost(spark, sf):
    return feedback.cooccurrence(observed(spark, sf)).withColumn("w", F.round("w", 7))


@query(f"WITH {OBS} SELECT qhash, skill, seq FROM o WHERE qhash IN (SELECT qhash FROM o GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM o) + INTERVAL 25 DAY - INTERVAL 30 DAY)")
def prune(spark, sf):
    """The log as it stands 25 days after its end: users whose last event is older than 30 days are gone."""
    o = observed(spark, sf)
    now = o.agg((F.max("ts") + F.expr("interval 25 days")).alias("m")).first()["m"]
    return feedback.prune(o, now).select("qhash", "skill", "seq")


@query()
def beta_sample(spark, sf):
    o = observed(spark, sf)
    return feedback.boosts(o.select("qhash").distinct(), feedback.live_posteriors(o), seed=7)


@query()
def als_factors(spark, sf):
    return feedback.als_factors(observed(spark, sf))[0]


@query("""WITH p AS (SELECT doc_id AS id, unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]{2,}'))) AS token FROM documents), tf AS (SELECT id, token, count(*) AS tf FROM p GROUP BY 1, 2),
dl AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) + len(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]{2,}')) AS dl FROM documents), c AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), tdf AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS token FROM benchmark),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(a, 1)))) AS score FROM q JOIN tdf USING (token) JOIN tf USING (token) JOIN dl USING (id), c GROUP BY 1, 2) """ + TOP.format("s", ""))
def plugin_bm25_tf(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws(" ", "source", "lang").alias("name"))
    return bm25.top_k(bm25.boosted_scores(asked(spark, sf), d, F.col("name"), F.col("text")), K, 6)


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS term FROM part),
m AS (SELECT word, term, levenshtein(word, term) AS dist FROM w JOIN t ON abs(length(word) - length(term)) <= 2 WHERE word NOT IN (SELECT term FROM t) AND levenshtein(word, term) <= 2)
SELECT word, arg_min(term, (dist, term)) AS term, CAST(min(dist) AS INTEGER) AS dist FROM m GROUP BY 1""")
def fuzzy_correct(spark, sf):
    words = lambda df, c, a: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))).alias(a)).distinct()
    return routing.corrections(words(table(spark, sf, "benchmark"), "text", "word"), words(table(spark, sf, "part"), "p_name", "term"))


@query()
def layered_pipeline(spark, sf):
    parts = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("name"), F.col("p_name").alias("text"))
    vocabulary = parts.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).distinct()
    triggers = spark.createDataFrame(TRIGGERS[2:], "phrase string, skill string, ord int")
    return routing.layers(talk(spark, sf), parts, triggers, spark.createDataFrame(RULES[:1], "pos int, pattern string, skill string"), vocabulary)


def _names(spark, sf):
    """Names that show the edge rules' words, made of part types."""
    words = F.array(*[F.lit(w) for w in ("auth", "login", "scan", "fix", "build", "deploy", "review", "test", "python", "go", "search", "extract")])
    return table(spark, sf, "part").select(F.concat_ws("-", F.lower("p_type"), F.element_at(words, (F.col("p_size") % 12 + 1).cast("int"))).alias("name"), "p_partkey", "p_brand", "p_size", "p_retailprice")


@query("""WITH n AS (SELECT DISTINCT lower(p_type) || '-' || (['auth', 'login', 'scan', 'fix', 'build', 'deploy', 'review', 'test', 'python', 'go', 'search', 'extract'])[p_size % 12 + 1] AS name FROM part),
k(i, a, b) AS (VALUES """ + ", ".join(f"({i}, '{'|'.join(a)}', '{'|'.join(b)}')" for i, (a, b) in enumerate([(("auth",), ("auth",)), (("login", "认证"), ("auth",)), *graph.CHAINS])) + """),
l(x) AS (VALUES """ + ", ".join(f"('{x}')" for x in graph.LANGUAGES) + """),
d AS (SELECT DISTINCT s.name AS src, t.name AS dst, 'depends_on' AS type FROM n s JOIN k ON regexp_matches(s.name, k.a) JOIN n t ON regexp_matches(t.name, k.b) AND t.name <> s.name),
c AS (SELECT s.name AS src, t.name AS dst FROM n s JOIN l ON contains(s.name, x) JOIN n t ON contains(t.name, x) AND t.name <> s.name UNION SELECT s.name, t.name FROM n s JOIN n t ON s.name <> t.name AND ((contains(s.name, 'review') AND contains(t.name, 'test')) OR (contains(s.name, 'test') AND contains(t.name, 'review'))))
SELECT * FROM d UNION ALL SELECT src, dst, 'complements' FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM c) WHERE r <= 5""")
def typed_edges(spark, sf):
    return graph.typed_edges(_names(spark, sf))


@query()
def plan_topo(spark, sf):
    p = _names(spark, sf)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    chosen = p.withColumn("rank", place).filter("rank <= 5").select(F.col("p_brand").alias("query_id"), "rank", F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").alias("score"))
    items = p.select(F.col("p_partkey").cast("string").alias("name"), F.array((F.col("p_size") % 7).cast("string")).alias("provides"), F.array(((F.col("p_size") + 1) % 7).cast("string")).alias("needs"))
    return topology.plan(chosen, items)


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_KEEP = f"lambda x: NOT list_contains({_STOPS}, x)"
# Other letters than a-z count as word characters at a word's edge; DuckDB's patterns know ASCII ones only, so a digit stands for them.
TERMS_SQL = f"""x AS (SELECT doc_id AS id, text, regexp_replace(coalesce(text, ''), '[^\\P{{L}}a-zA-Z]', '0', 'g') AS a FROM documents),
bag AS (SELECT id, unnest(list_concat(list_filter(regexp_extract_all(lower(a), '\\b[a-z]{{3,}}(?:[-/][a-z]{{2,}})*\\b'), {_KEEP}), list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\x{{4e00}}-\\x{{9fff}}]{{2,6}}'), {_KEEP}),
  list_transform(regexp_extract_all(a, '\\b(?:[A-Z][a-z]+){{2,}}\\b'), lambda x: lower(x)), list_filter(flatten(list_transform(regexp_extract_all(a, '\\b[a-z]+(?:_[a-z]+)+\\b'), lambda x: string_split(x, '_'))), lambda x: length(x) >= 3 AND NOT list_contains({_STOPS}, x)))) AS term FROM x),
n AS (SELECT count(*) AS n FROM documents), tdf AS (SELECT term, count(DISTINCT id) AS df FROM bag GROUP BY 1),
terms AS (SELECT term, df, round((ln((n + 1.0::DOUBLE) / (df + 1)) + 1) * (1 + 0.3::DOUBLE * (len(regexp_split_to_array(term, '[-/]')) - 1)), 9) AS weight FROM tdf, n WHERE df >= greatest(3, floor(0.015::DOUBLE * n)) AND df / n::DOUBLE <= 0.75 ORDER BY weight DESC, term LIMIT 200)"""


@query(f"WITH {TERMS_SQL} SELECT * FROM terms")
def discover_terms(spark, sf):
    return discovery.candidate_terms(docs(spark, sf), STOP)


@query(f"""WITH {TERMS_SQL}, m AS (SELECT id, term, count(*) AS m FROM bag SEMI JOIN terms USING (term) GROUP BY 1, 2),
c AS (SELECT p.term AS a, q.term AS b, sum(CASE WHEN p.term = q.term THEN p.m * (p.m - 1) ELSE p.m * q.m END) AS c FROM m p JOIN m q USING (id) GROUP BY 1, 2)
SELECT a, b, round(c / t, 9) AS share FROM (SELECT a, b, c::DOUBLE AS c, sum(c) OVER (PARTITION BY a)::DOUBLE AS t FROM c) WHERE c > 0""")
def discover_cooccurrence(spark, sf):
    d = docs(spark, sf)
    return discovery.cooccurrence(d, cut(discovery.candidate_terms(d, STOP)), STOP).withColumn("share", F.round("share", 9))


_FOUND = {f: [k.strip("\\b") for k in ks] for t in LEXICON.values() for f, ks in t.items()}


@query("WITH f(feature, kw) AS (VALUES " + ", ".join(f"('{f}', '{k}')" for f, ks in _FOUND.items() for k in ks) + """), n AS (SELECT count(*) AS n FROM documents), every AS (SELECT DISTINCT feature FROM f),
c AS (SELECT feature, count(*) AS c FROM (SELECT DISTINCT doc_id, feature FROM documents JOIN f ON contains(lower(text), kw)) GROUP BY 1),
s AS (SELECT feature, coalesce(c, 0) / n::DOUBLE AS share FROM every LEFT JOIN c USING (feature), n)
SELECT feature, CASE WHEN share >= least(0.15::DOUBLE, greatest(0.08::DOUBLE, 2.0::DOUBLE / greatest(n, 10))) AND row_number() OVER (ORDER BY share DESC, feature) <= 14 THEN 'broad' ELSE 'precise' END AS tier FROM s, n""")
def split_broad_precise(spark, sf):
    made = discovery.split_tiers(docs(spark, sf), _FOUND)
    return spark.createDataFrame([(f, t) for t, fs in made.items() for f in fs], "feature string, tier string")


@query("""WITH t AS (SELECT lower(r_name) AS feature, lower(n_name) AS term FROM nation JOIN region ON n_regionkey = r_regionkey),
base(feature, kw) AS (VALUES """ + ", ".join(f"('{f}', '{k.lower()}')" for t in LEXICON.values() for f, ks in t.items() for k in ks) + """),
g AS (SELECT feature, list_sort(list(DISTINCT term)) AS ts FROM t GROUP BY 1), ok AS (SELECT count(DISTINCT term) AS u, count(*) AS c FROM (SELECT unnest(ts) AS term FROM g)),
novel AS (SELECT feature, list_filter(ts, lambda x: length(x) >= 3 AND NOT list_contains([""" + ", ".join(f"'{k.lower()}'" for t in LEXICON.values() for ks in t.values() for k in ks) + """], x)) AS ts FROM g, ok WHERE u >= 10 AND u >= 0.3 * c AND feature NOT IN (SELECT feature FROM base))
SELECT feature, unnest(ts[1:8]) AS term FROM novel WHERE len(ts) >= 3""")
def merge_lexicon(spark, sf):
    """Features of regions with their nations' names, merged into the lexicon: the new features' terms."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("feature"), F.lower("n_name").alias("term"))
    found = {r["feature"]: r["terms"] for r in rows.groupBy("feature").agg(F.array_sort(F.collect_set("term")).alias("terms")).collect()}  # a row a region
    merged = L.merge_discovered(LEXICON, {"precise": found})["precise"]
    return spark.createDataFrame([(f, k) for f, ks in merged.items() if f not in LEXICON["precise"] for k in ks], "feature string, term string")


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS dist FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def levenshtein_pairs(spark, sf):
    n = table(spark, sf, "nation")
    a, b = (n.select(F.col("n_name").alias(x), F.col("n_nationkey").alias(f"k{x}"), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").filter("ka < kb").select("a", "b", F.levenshtein("a", "b").alias("dist"))


@query()
def discover_clusters(spark, sf):
    d = docs(spark, sf)
    terms = discovery.candidate_terms(d, STOP)
    found = discovery.clusters(terms, discovery.cooccurrence(d, terms, STOP), d.count())
    return discovery.coverage(d, found)


@query(f"""WITH {FEATS}, nm AS (SELECT DISTINCT id, feature FROM df), per AS (SELECT doc_id, list_sort(list(feature)) FILTER (feature IS NOT NULL) AS fs, count(feature) AS k FROM documents LEFT JOIN nm ON id = doc_id GROUP BY 1)
SELECT round(1 - count(*) FILTER (k = 0) / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER (k = 0) AS empty, round(avg(k), 6) AS mean_features, (SELECT count(DISTINCT feature) FROM nm) AS features FROM per""".replace("list_sort(list(feature)) FILTER (feature IS NOT NULL) AS fs, ", ""))
def quality_report(spark, sf):
    d = docs(spark, sf)
    return discovery.quality_report(d, L.long_features(d, LEXICON)).select(F.round("coverage", 6).alias("coverage"), "empty", F.round("mean_features", 6).alias("mean_features"), "features")


def _labelled(spark, sf):
    ranked = _knn(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst")))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("name"))
    ranked = ranked.join(e.withColumnRenamed("vec_id", "dst"), "dst").select(F.col("src").alias("query_id"), "rank", "name")
    return e.select(F.col("vec_id").alias("query_id"), F.array("name").alias("expected")), ranked


@query(f"WITH {KNN}, r AS (SELECT src, min(rk) AS f FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rk FROM kn) k JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst AND a.label = b.label GROUP BY 1) SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS mrr, round(avg(CASE WHEN f IS NULL THEN 0.0::DOUBLE ELSE 1 END), 9) AS hit FROM embeddings LEFT JOIN r ON src = vec_id")
def eval_mrr_hit(spark, sf):
    return evaluate.mrr_hit(*_labelled(spark, sf)).select("queries", F.round("mrr", 9).alias("mrr"), F.round("hit", 9).alias("hit"))


DIMS = "q AS (SELECT vec_id AS query_id, 'd' || i AS feature FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) WHERE x > 0.2), xf AS (SELECT name, 'd' || i AS feature FROM (SELECT CAST(label AS VARCHAR) AS name, i, count(*) FILTER (x > 0) AS up, count(*) AS n FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2) WHERE up * 20 > n * 11)"


def _dims(spark, sf):
    """Features of vectors (components over 0.2) and of labels (components that are positive on over 55 % of a label's vectors)."""
    x = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("name"), F.posexplode("embedding").alias("i", "x")).withColumn("feature", F.concat(F.lit("d"), (F.col("i") + 1).cast("string")))
    of_labels = x.groupBy("name", "feature").agg(F.sum((F.col("x") > 0).cast("long")).alias("up"), F.count("*").alias("n")).filter("up * 20 > n * 11").select("name", "feature")
    return x.filter("x > cast(0.2 as float)").select(F.col("vec_id").alias("query_id"), "feature"), of_labels


@query(f"""WITH {KNN}, {DIMS}, r AS (SELECT DISTINCT src AS query_id, CAST(b.label AS VARCHAR) AS name FROM kn JOIN embeddings b ON b.vec_id = dst),
miss AS (SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS name FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = vec_id AND r.name = CAST(label AS VARCHAR))),
cnt AS (SELECT query_id, name, count(*) FILTER (q.feature IS NOT NULL) AS s, count(*) FILTER (q.feature IS NULL AND xf.feature IS NOT NULL) AS o, string_agg(q.feature, ',' ORDER BY q.feature) AS shared FROM miss LEFT JOIN xf USING (name) LEFT JOIN q USING (query_id, feature) GROUP BY 1, 2)
SELECT query_id, name, coalesce(shared, '') AS shared, o AS n_item_only, o > 3 * s AS diluted FROM cnt""")
def diagnose_miss(spark, sf):
    wanted, ranked = _labelled(spark, sf)
    made = evaluate.diagnose(wanted, ranked, *_dims(spark, sf))
    return made.select("query_id", "name", F.array_join("shared", ",").alias("shared"), F.size("item_only").cast("long").alias("n_item_only"), "diluted")


@query(f"""WITH {KNN}, {DIMS}, r AS (SELECT query_id, name, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, name) AS rank FROM (SELECT src AS query_id, CAST(b.label AS VARCHAR) AS name, max(w) AS w FROM kn JOIN embeddings b ON b.vec_id = dst GROUP BY 1, 2)) WHERE rank <= 10),
a AS (SELECT vec_id AS query_id, unnest(['0', '1', 'none']) AS name FROM embeddings),
l AS (SELECT query_id, list(feature) AS q FROM q GROUP BY 1), m AS (SELECT name, list(feature) AS x FROM xf GROUP BY 1)
SELECT query_id, name, round(coalesce(w, 0), 6) AS score, round(len(list_intersect(coalesce(q, []), coalesce(x, []))) / greatest(len(list_distinct(list_concat(coalesce(q, []), coalesce(x, [])))), 1)::DOUBLE, 9) AS jaccard, array_to_string(list_sort(list_intersect(coalesce(q, []), coalesce(x, []))), ',') AS shared, x IS NOT NULL AS known
FROM a LEFT JOIN r USING (query_id, name) LEFT JOIN l USING (query_id) LEFT JOIN m USING (name)""")
def compare_skills(spark, sf):
    e = table(spark, sf, "embeddings")
    best = _knn(spark, sf).join(e.select(F.col("vec_id").alias("dst"), F.col("label").cast("string").alias("name")), "dst").groupBy(F.col("src").alias("query_id"), "name").agg(F.max("w").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name")))
    names = e.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("none"))).alias("name"))
    made = evaluate.compare(*_dims(spark, sf), names, ranked)
    return made.select("query_id", "name", F.round("score", 6).alias("score"), F.round("jaccard", 9).alias("jaccard"), F.array_join("shared", ",").alias("shared"), "known")


@query(f"WITH {FEATS}, cats(feature, cat) AS (VALUES " + ", ".join(f"('{f}', {c})" for f, c in CATEGORIES) + """), x AS (SELECT DISTINCT query_id AS id, cat, feature FROM qf JOIN cats USING (feature)), n AS (SELECT id, cat, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT p.id AS i, q.id AS j, cat, count(*) AS c FROM x p JOIN x q USING (cat, feature) WHERE p.id <> q.id GROUP BY 1, 2, 3)
SELECT i, j, cat, round(c / (a.n + b.n - c)::DOUBLE, 9) AS val FROM c JOIN n a ON a.id = i AND a.cat = c.cat JOIN n b ON b.id = j AND b.cat = c.cat""".replace("SELECT i, j, cat, round", "SELECT i, j, c.cat, round"))
def category_tensor(spark, sf):
    cats = spark.createDataFrame(CATEGORIES, "feature string, cat int")
    return vectors.category_tensor(_qf(spark, sf), cats).withColumn("val", F.round("val", 9))


@query(ORACLES["typed_edges"].replace("SELECT * FROM d UNION ALL", "SELECT * FROM (SELECT * FROM d) UNION ALL").partition("SELECT * FROM (SELECT * FROM d)")[0] + """, sc AS (SELECT p_brand AS query_id, lower(p_type) || '-' || (['auth', 'login', 'scan', 'fix', 'build', 'deploy', 'review', 'test', 'python', 'go', 'search', 'extract'])[p_size % 12 + 1] AS id, round(max(p_retailprice) / 2500, 6)::DOUBLE AS score FROM part GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 10 AND score > 0.1),
gv AS (SELECT query_id, dst AS id, max(score) * 0.7::DOUBLE AS given FROM top JOIN d ON d.src = top.id GROUP BY 1, 2)
SELECT coalesce(sc.query_id, gv.query_id) AS query_id, coalesce(sc.id, gv.id) AS id, round(greatest(coalesce(score, 0), coalesce(given, 0)), 6) AS score, given IS NOT NULL AS required FROM sc FULL JOIN gv ON sc.query_id = gv.query_id AND sc.id = gv.id""")
def dep_pull(spark, sf):
    n = _names(spark, sf)
    scored = n.groupBy(F.col("p_brand").alias("query_id"), F.col("name").alias("id")).agg(F.round(F.max("p_retailprice") / 2500, 6).cast("double").alias("score"))
    depends = graph.typed_edges(n).filter("type = 'depends_on'").select("src", "dst")
    return graph.pull_dependencies(scored, depends).withColumn("score", F.round("score", 6))


@query("SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in X.SECURITY_FLAGS) + "], lambda x: x IS NOT NULL), ',') AS flags FROM pages")
def security_flags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(X.security_flags(F.col("html")), ",").alias("flags"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in X.SECURITY_FLAGS) + "], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def security_flags_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.security_flags(F.col("text")), ",").alias("flags"))


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(h, '(?:import|from)\\s+(\\w+)', 1), lambda x: lower(x)), lambda x: length(x) >= 2), list_transform(regexp_extract_all(h, '@(\\w+)', 1), lambda x: lower(x)),
  list_transform(flatten(list_transform(regexp_extract_all(h, 'class\\s+(\\w+)', 1), lambda x: regexp_extract_all(x, '[A-Z][a-z]+'))), lambda x: lower(x)),
  flatten(list_transform(list_filter(regexp_extract_all(h, 'def\\s+(\\w+)', 1), lambda x: NOT starts_with(x, '_')), lambda x: regexp_extract_all(lower(x), '[a-z]{3,}'))))))[1:30], ',') AS keywords FROM p""")
def code_keywords(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(X.code_keywords(F.col("html")), ",").alias("keywords"))


@query("WITH b AS (SELECT o_orderkey, o_totalprice AS a FROM orders WHERE o_orderstatus <> 'F'), c AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS b FROM orders WHERE o_orderstatus <> 'P') SELECT o_orderkey, change FROM (SELECT o_orderkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN abs(a - b) > 0.1 THEN 'changed' END AS change FROM b FULL JOIN c USING (o_orderkey)) WHERE change IS NOT NULL")
def snapshot_diff(spark, sf):
    o = table(spark, sf, "orders")
    after = o.filter("o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0))
    return evaluate.snapshot_diff(o.filter("o_orderstatus <> 'F'"), after, "o_orderkey", "o_totalprice")


def entry(spark: SparkSession) -> DataFrame:
    return bm25_topk(spark, "/root/testdata/sf0.001")
