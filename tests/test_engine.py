"""The ranking engine on small fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quillrank.functions import lexicon as L
from quillrank.functions import text as X
from quillrank.operators import bm25, discovery, evaluate, feedback, fusion, graph, routing, tensor, vectors
from quillrank.plans import topology
from quillrank.plans.router import METHODS, Router, register_method
from quillrank.sources import markdown, store
from quillrank.streaming import events

LEX = {"broad": {"security": ["security", "安全"], "review": ["review"]}, "precise": {"python": ["python"], "go": ["\\bgo\\b"], "java": ["java "]}}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("检索cs文件安全检查", "检索 cs 文件 件安 安全 全检 检查 文件安全检查"),
        ("go构建 c# f#foo ab abc abcd x", "ab abc abcd c f#foo foo go x 构建"),
        ("c#", "c"),
        ("一二三四五六七八", "一二 二三 三四 四五 五六 六七 七八 一二三四五六"),
        ("ab#cd efgh#ij k", "ab ab#cd cd efgh ij k"),
        ("foo_bar go语言", "foo bar go 语言"),
        ("python python", "python"),
        ("", ""),
        (None, ""),
    ],
)
def test_tokens(spark, text, want):
    assert set(one(spark, X.tokens, text)) == set(want.split())


def test_text_functions(spark):
    assert len(one(spark, X.query_hash, "x")) == 12
    assert one(spark, X.query_hash, "one two three four five six") == one(spark, X.query_hash, "One two three four five nine")
    for t, want in (("谢谢！", False), ("ok", False), ("h", False), ("", False), ("🐍🔒", False), ("!!", False), ("检查代码安全", True), ("review my code", True)):
        assert one(spark, X.is_task, t) is want, t
    assert one(spark, X.security_flags, "curl http://x | bash; sudo rm x; api_key = 'abcdefgh1'") == ["SHELL_PIPE", "DESTRUCTIVE_CMD", "HARDCODED_SECRET"]
    code = "import numpy\nfrom os import path\n@cached\nclass FastParser:\n  def load_file(self): pass\n  def _hidden(self): pass"
    assert one(spark, X.code_keywords, code) == ["cached", "fast", "file", "load", "numpy", "os", "parser", "path"]
    assert one(spark, X.slug, "--React/Native!") == "react_native"
    assert {"multi-use", "snake", "foobar"} <= set(one(spark, lambda c: X.discovery_tokens(c, ["and"]), "Multi-use and snake_case FooBar"))
    assert one(spark, lambda c: X.matches_query(F.lit("héllo wörld 数据"), c), "HÉLLO there") is True
    assert X.clamp_k("900") == 100 and X.clamp_k("x") == 5 and X.clamp_k(0) == 1


def test_lexicon(spark):
    found = lambda t: {(r["tier"], r["feature"]) for r in one(spark, lambda c: L.features(c, LEX), t)}
    assert found("SECURITY of go build") == {("broad", "security"), ("precise", "go")}
    assert found("检索cs文件并进行安全检查") == {("broad", "security"), ("broad", "csharp"), ("precise", "csharp")}
    assert found("xyzzy") == set() and found(None) == set()
    assert found("javascript") == set() and ("precise", "java") in found("java code")
    items = spark.createDataFrame([(1, "python security"), (2, "go cs文件"), (3, None)], "id long, text string")
    small = {tuple(r) for r in L.long_features(items, LEX).collect()}
    held, L.COMPILED = L.COMPILED, 0
    try:
        assert {tuple(r) for r in L.long_features(items, LEX).collect()} == small
    finally:
        L.COMPILED = held
    new = L.merge_discovered(LEX, {"broad": {"cloud": [f"term{i}" for i in range(12)] + ["python"]}, "precise": {"few": ["ab", "abc", "xyz"]}}, {"broad": {"review": ["mine"]}})
    assert new["broad"]["cloud"] == [f"term{i}" for i in range(10)] and "few" not in new["precise"] and new["broad"]["review"] == ["mine"]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, f"skill-{i}", " ".join(["common"] + ["security"] * (i % 3 == 0) + ["python"] * (i % 4 == 0) + ["review"] * (i % 5 == 0))) for i in range(30)]
    return spark.createDataFrame(rows, "id long, name string, text string").cache()


def brute_hybrid(n, signals, q, k, digits=9):
    bm, cos, _ = (signals[m].get(q, {}) for m in ("bm25", "cosine", "graph"))
    coverage = sum(v > 0 for v in bm.values()) / n
    top = sorted(cos.values(), reverse=True) + [0.0, 0.0]
    if coverage < 0.05 and n >= 2 and top[0] - top[1] < 0.005:
        return []
    score = [0.0] * n
    for m in signals:
        w = (0.2 if coverage < 0.2 else 1.0) if m == "bm25" else fusion.WEIGHTS[m]
        s = signals[m].get(q, {})
        for r, i in enumerate(sorted(range(n), key=lambda i: (-round(s.get(i, 0.0), digits), i))):
            score[i] += w / (60 + r)
    return [(r + 1, i) for r, i in enumerate(sorted(range(n), key=lambda i: (-round(score[i], digits), i))[:k])]


def test_hybrid_equals_full_frame(spark, items):
    r = Router(items, LEX)
    q = spark.createDataFrame([(1, "python security"), (2, "review"), (3, "nothing here"), (4, "skill common"), (5, "")], "query_id long, query string")
    signals = {"bm25": r.scores(q, "keyword"), "cosine": r.scores(q, "cosine"), "graph": r.scores(q, "graph_spread")}
    plain = {m: {} for m in signals}
    for m, s in signals.items():
        for x in s.collect():
            plain[m].setdefault(x["query_id"], {})[x["id"]] = x["score"]
    for k in (3, 10, 50):
        got = {}
        for x in r.rank(q, k).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["id"]))
        for i in range(1, 6):
            assert sorted(got.get(i, [])) == brute_hybrid(30, plain, i, k), (i, k)
    assert r.rank(q, 0).count() == 0


def test_router_methods_and_rules(spark, items):
    r = Router(items, LEX)
    q = spark.createDataFrame([(1, "python security")], "query_id long, query string")
    for m in ("keyword", "cosine", "jaccard", "tfidf", "graph_spread", "tensor"):
        got = r.rank(q, 5, m).collect()
        assert len(got) == 5 and all(x["score"] >= 0 for x in got), m
    with pytest.raises(ValueError):
        r.rank(q, 5, "unknown")

    @register_method("by_id")
    def by_id(router, queries):
        return queries.select("query_id").join(router.items.select("id"), how="cross").withColumn("score", F.col("id").cast("double"))

    assert [x["id"] for x in r.rank(q, 2, "by_id").orderBy("rank").collect()] == [29, 28]
    del METHODS["by_id"]
    rules = spark.createDataFrame([(0, "python", "gone"), (1, "PYTHON.*sec", "skill-7")], "pos int, pattern string, skill string")
    got = r.query(q, 3, rules=rules).orderBy("rank").collect()
    assert got[0]["name"] == "skill-7" and got[0]["score"] == 1.0 and len(got) == 3
    with pytest.raises(ValueError):
        Router(items.filter("false"), LEX)
    single = Router(items.filter("id = 0"), LEX).rank(q, 5).collect()
    assert [(x["rank"], x["score"]) for x in single] == [(1, 1.0)]
    assert r.item("skill-3").first()["id"] == 3 and r.item("none").count() == 0


def test_corrections_move_results(spark, items):
    r = Router(items, LEX)
    q = spark.createDataFrame([(1, "python security")], "query_id long, query string")
    h = q.select(X.query_hash(F.col("query")).alias("h")).first()["h"]
    now = datetime(2026, 1, 15)
    log = spark.createDataFrame([(h, "skill-1", 5.0, now)], "qhash string, skill string, boost double, ts timestamp")
    assert r.query(q, 3, corrections=log, now=now).filter("rank = 1").first()["name"] == "skill-1"
    seen = spark.createDataFrame([(h, "skill-29", 50, 1)], "qhash string, skill string, weight int, seq long")
    assert r.query(q, 30, observations=seen).filter("name = 'skill-29'").count() == 1


def test_feedback(spark):
    now = datetime(2026, 1, 15)
    log = spark.createDataFrame([("q", "a", 1.0, now), ("q", "a", 1.0, now), ("old", "a", 1.0, now - timedelta(days=40)), ("two", "b", 1.0, now - timedelta(days=14))], "qhash string, skill string, boost double, ts timestamp")
    book = feedback.error_book(log, now)
    base = spark.createDataFrame([("q", "a", 0.04), ("q", "b", 0.03), ("two", "b", 0.1), ("old", "a", 0.2)], "qhash string, skill string, score double")
    got = {(r["qhash"], r["skill"]): round(r["score"], 6) for r in feedback.adjust(base, book, now).collect()}
    assert got == {("q", "a"): 0.064, ("q", "b"): 0.03, ("two", "b"): 0.103, ("old", "a"): 0.2}
    assert tuple(feedback.book_stats(book, now).first()) == (2, 2.25, 2)
    obs = spark.createDataFrame([("q", "a", 2, 1), ("q", "b", 1, 2), ("q", "a", 1, 3)], "qhash string, skill string, weight int, seq long")
    live = {r["skill"]: (r["alpha"], round(r["beta"], 6)) for r in feedback.live_posteriors(obs).collect()}
    assert live == {"a": (4.0, 1.2), "b": (2.0, 1.2)}
    q = spark.createDataFrame([("q",)], "qhash string")
    post = feedback.live_posteriors(obs)
    assert sorted(map(tuple, feedback.boosts(q, post, 3).collect())) == sorted(map(tuple, feedback.boosts(q, post.repartition(5), 3).collect()))
    users, skills = feedback.als_factors(obs)
    assert users.count() == 1 and skills.count() == 2


def test_graph(spark):
    v = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (2, "x", 1.0), (3, "y", 2.0), (4, "z", 1.0)], "id long, feature string, w double")
    pairs = {(r[0], r[1]): round(r[2], 6) for r in graph.pair_cosines(v).collect()}
    assert pairs == {(1, 2): 0.707107, (2, 1): 0.707107, (1, 3): 0.707107, (3, 1): 0.707107}
    g = graph.degree_normalise(graph.nearest(graph.pair_cosines(v), 1))
    w = {(r[0], r[1]): r[2] for r in g.collect()}
    assert all(abs(w[b, a] - x) < 1e-12 for (a, b), x in w.items())
    start = spark.createDataFrame([(1, 1, 0.5)], "query_id long, id long, score double")
    got = {r["id"]: r["score"] for r in graph.spread(start, spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, w double")).collect()}
    assert got == {1: 0.5 + 0.5 * 0.5 * 0.25, 2: 0.25 + 0.5 * 0.5 * 0.25 * 0.125}
    edges = graph.typed_edges(spark.createDataFrame([("build-x",), ("deploy-x",), ("user-login",), ("auth",), ("review-go",), ("test-go",)], "name string"))
    assert {tuple(r) for r in edges.collect()} >= {("build-x", "deploy-x", "depends_on"), ("user-login", "auth", "depends_on"), ("review-go", "test-go", "complements"), ("test-go", "review-go", "complements")}
    dense = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    assert {(r[0], r[1]) for r in graph.nearest_dense(dense, 1, "id", "v", block=2).collect()} == {(1, 2), (2, 1), (3, 2)}
    scored = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0)], "query_id long, id long, score double")
    pulled = graph.pull_dependencies(scored, spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert {(r["id"], r["score"], r["required"]) for r in pulled.collect()} == {(1, 1.0, False), (2, 0.7, True)}


def test_tensor_factors_rebuild_cells(spark):
    cells = [(i, j, c, 1.0) for c in (0, 1) for i in range(6) for j in range(6) if i != j and (i + j + c) % 2 == 0]
    items = spark.createDataFrame([(i,) for i in range(6)], "id long")
    f = {r["id"]: r["f"] for r in tensor.factors(spark.createDataFrame(cells, "i long, j long, cat int, val double"), items, rank=3, rounds=3).collect()}
    assert set(f) == set(range(6)) and all(len(x) == 3 for x in f.values())


def test_plan(spark):
    items = spark.createDataFrame([("auth", ["token"], None), ("api", ["Data"], ["TOKEN"]), ("db", None, ["data"]), ("x", ["p"], ["r"]), ("y", ["r"], ["p"])], "name string, provides array<string>, needs array<string>")
    chosen = spark.createDataFrame([(1, 1, "db", 0.9), (1, 2, "api", 0.8), (1, 3, "auth", 0.7), (2, 1, "x", 0.9), (2, 2, "y", 0.8), (2, 3, "auth", 0.1)], "query_id long, rank int, name string, score double")
    got = {}
    for r in topology.plan(chosen, items).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append((r["name"], r["resolved"]))
    assert got == {1: [("auth", True), ("api", True), ("db", True)], 2: [("auth", True), ("x", False), ("y", False)]}
    none = spark.createDataFrame([("auth", None, None), ("db", None, None), ("api", None, None)], items.schema)
    assert [r["name"] for r in topology.plan(chosen.filter("query_id = 1"), none).orderBy("pos").collect()] == ["db", "api", "auth"]
    linked = topology.plan(chosen.filter("query_id = 1"), none, spark.createDataFrame([("db", "auth")], "src string, dst string"))
    assert [r["name"] for r in linked.orderBy("pos").collect()] == ["api", "auth", "db"]
    assert topology.to_prompt(linked).first()["prompt"] == "1. api\n2. auth\n3. db"


def test_layers(spark):
    items = spark.createDataFrame([(1, "reviewer", "security review python"), (2, "builder", "build code")], "id long, name string, text string")
    q = spark.createDataFrame([(1, "thanks"), (2, "run the trigger now"), (3, "search some cs"), (4, "python help"), (5, "pythn securty"), (6, "zzzzzzzz qqqqqqqq")], "query_id long, query string")
    triggers = spark.createDataFrame([("trigger", "t1", 0), ("trigger now", "t2", 1)], "phrase string, skill string, ord int")
    rules = spark.createDataFrame([(0, "search.*cs", "finder")], "pos int, pattern string, skill string")
    vocabulary = spark.createDataFrame([("python",), ("security",), ("review",)], "term string")
    got = {r["query_id"]: (r["layer"], r["name"]) for r in routing.layers(q, items, triggers, rules, vocabulary).filter("rank < 2").collect()}
    assert got == {1: ("skip", None), 2: ("trigger", "t2"), 3: ("rule", "finder"), 4: ("keyword", "reviewer"), 5: ("fuzzy", "reviewer"), 6: ("none", None)}


def test_discovery(spark):
    rows = [(i, "kubernetes cluster deploy" if i % 2 else "react component render") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string")
    lex = discovery.discover(docs)
    assert sorted(len(ks) for fs in lex.values() for ks in fs.values()) == [3, 3]
    report = discovery.quality_report(docs, L.long_features(docs, lex)).first()
    assert report["coverage"] == 1.0 and report["empty"] == 0 and report["largest_group"] == 20
    assert discovery.item_keywords(docs).first()["keywords"][0] in ("kubernetes", "component")
    assert discovery.recommendation(85) == "good"


def test_evaluation(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["z"])], "query_id long, expected array<string>")
    ranked = spark.createDataFrame([(1, 1, "x", 0.9), (1, 2, "b", 0.8), (2, 1, "c", 0.7)], "query_id long, rank int, name string, score double")
    row = evaluate.mrr_hit(q, ranked).first()
    assert (row["queries"], row["mrr"], round(row["hit"], 4)) == (3, 0.5, 0.6667)
    assert evaluate.mrr_hit(q.filter("false"), ranked).first()["mrr"] == 0
    qf = spark.createDataFrame([(1, "s"), (3, "t")], "query_id long, feature string")
    xf = spark.createDataFrame([("a", "s"), ("a", "u"), ("a", "v"), ("a", "w"), ("a", "k"), ("b", "s")], "name string, feature string")
    miss = {r["name"]: (r["shared"], r["diluted"]) for r in evaluate.diagnose(q, ranked, qf, xf).collect()}
    assert miss == {"a": (["s"], True), "z": ([], False)}
    names = spark.createDataFrame([(1, "b"), (1, "nope")], "query_id long, name string")
    got = [tuple(r)[1:] for r in evaluate.compare(qf, xf, names, ranked).collect()]
    assert got == [("b", 0.8, 1.0, ["s"], True), ("nope", 0.0, 0.0, [], False)]
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "k long, v double")
    b = spark.createDataFrame([(2, 1.05), (3, 2.0), (4, 1.0)], "k long, v double")
    assert {tuple(r) for r in evaluate.snapshot_diff(a, b, "k", "v").collect()} == {(1, "removed"), (3, "changed"), (4, "added")}


def test_vectors(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 1.0)], "id long, score double")
    assert [round(r["score"], 4) for r in vectors.normalise(df).orderBy("id").collect()] == [0.0, 0.4444, 1.0]
    assert {r["score"] for r in vectors.normalise(df.withColumn("score", F.lit(2.0))).collect()} == {0.0}
    items = spark.createDataFrame([(1, "reviewer", "python"), (2, "other", "reviewer")], "id long, name string, text string")
    q = spark.createDataFrame([(1, "reviewer")], "query_id long, query string")
    assert bm25.top_k(bm25.boosted_scores(q, items, F.col("name"), F.concat_ws(" ", "name", "text")), 1).first()["id"] == 1


def test_markdown_and_stores(spark, tmp_path):
    base = tmp_path / "skills"
    (base / "one").mkdir(parents=True)
    (base / "agents").mkdir()
    (base / "one/SKILL.md").write_text("---\nname: First\ndescription: Checks code\nrequires: [b]\n---\nBody\n## When to use\n- review code\n- check style\nDone now\n- not this")
    (base / "one/extra.md").write_text("not an item because of its neighbour")
    (base / "agents/plain.md").write_text("# Title\n## Alpha part\ntext enough for an item\n## Beta part")
    (base / "tiny.md").write_text("short")
    got = {r["name"]: r for r in markdown.load_items(spark, [str(base)]).collect()}
    assert set(got) == {"First", "plain"}
    assert got["First"]["search_text"] == "first checks code review code check style" and got["First"]["meta"]["requires"] == ["b"]
    assert got["plain"]["source"] == "agent" and got["plain"]["search_text"].endswith("alpha part beta part")
    assert sorted(r["id"] for r in got.values()) == [0, 1]
    assert [r["name"] for r in markdown.load_plugin_items(spark, [str(base)]).collect()] == ["First"]
    (tmp_path / "r.json").write_text(json.dumps([{"pattern": "a", "skill": "x"}, {"pattern": "b", "skill": "y"}]))
    (tmp_path / "t.json").write_text(json.dumps({"x": [" Go ", "run"], "y": ["stop"]}))
    (tmp_path / "q.json").write_text(json.dumps([{"query": "do", "expected": ["x"]}]))
    rules = markdown.load_rules(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in store.edit_rules(rules, add=("c", "z"), remove=0).orderBy("pos").collect()] == [(0, "b", "y"), (1, "c", "z")]
    assert {r["phrase"] for r in markdown.load_triggers(spark, str(tmp_path / "t.json")).collect()} == {"go", "run", "stop"}
    assert markdown.load_labelled_queries(spark, str(tmp_path / "q.json")).first()["expected"] == ["x"]
    store.save_index({"a": rules}, str(tmp_path / "index"))
    assert store.load_index(spark, str(tmp_path / "index"), ["a"])["a"].count() == 2
    ranked = spark.createDataFrame([(1, 2, "b", 0.12344), (1, 1, "a", 0.5)], "query_id long, rank int, name string, score double")
    assert json.loads(store.json_responses(ranked).first()["response"])[0] == {"rank": 1, "name": "a", "score": 0.5}
    assert store.context_block(ranked).first()["context"] == "1. a (0.500)\n2. b (0.123)"


def test_streams(spark, tmp_path):
    t = datetime(2026, 1, 1)
    src = str(tmp_path / "in")
    spark.createDataFrame([("q", "a", 1.0, t), ("q", "a", 1.0, t + timedelta(days=7)), ("r", "b", 2.0, t)], "qhash string, skill string, boost double, ts timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("qhash string, skill string, boost double, ts timestamp").parquet(src)
    run = events.decayed_boosts(stream).writeStream.format("memory").queryName("boosts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["qhash"], round(r["boost"], 6)) for r in spark.table("boosts").collect()} == {("q", 1.5), ("r", 2.0)}
    seen = []
    run = events.rebuild_on_change(spark.readStream.schema("qhash string, skill string, boost double, ts timestamp").parquet(src), lambda b: seen.append(b.count()), str(tmp_path / "c2"))
    run.processAllAvailable()
    run.stop()
    assert seen == [3]
    bursts = events.quiet_periods(spark.createDataFrame([(t,), (t + timedelta(seconds=1),), (t + timedelta(seconds=9),)], "ts timestamp"))
    assert sorted(r["changes"] for r in bursts.collect()) == [1, 2]
