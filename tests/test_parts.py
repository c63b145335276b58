"""Sources, sinks, discovery, feedback, saved routers, requests and commands on small fixtures."""

import json
import threading
import urllib.request
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quillrank import __main__ as commands
from quillrank.functions import lexicon as L
from quillrank.functions import text as X
from quillrank.operators import bm25, discovery, evaluate, feedback, fusion, graph, vectors
from quillrank.plans.router import Router
from quillrank.service import Service
from quillrank.sources import markdown, store, tables
from quillrank.streaming import events

NOW = datetime(2026, 1, 15)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lexicon_in_parts_equals_whole(spark, monkeypatch):
    lex = {"broad": {"a": ["x", "y"], "csharp": ["sharp"], "b": ["\\bgo\\b"]}, "precise": {"c": ["zed", "x"], "d": ["y "], "e": []}, "other": {"f": ["x"]}}
    items = spark.createDataFrame([(1, "x go zed"), (2, "go cs文件 sharp"), (3, None), (4, "y z")], "id long, text string")
    whole = rows(L.long_features(items, lex))
    assert ("other" not in {r[1] for r in whole}) and (2, "broad", "csharp") in whole and len(set(whole)) == len(whole)
    monkeypatch.setattr(L, "COMPILED", 1)
    assert len(L.parts(lex)) > 3 and rows(L.long_features(items, lex)) == whole
    assert set(L.sample_lexicon()) == {"broad", "precise"}


def test_clusters_take_all_terms_given(spark):
    terms = spark.createDataFrame([(f"term{i:03d}", 5, float(i)) for i in range(260)], "term string, df long, weight double")
    shares = spark.createDataFrame([("term001", "term000", 0.9), ("term001", "term002", 0.8)], "a string, b string, share double")
    assert discovery.clusters(terms, shares, 1000) == {"term001": ["term001", "term000", "term002"]}


def test_single_item_and_named_ranks(spark):
    items = spark.createDataFrame([(7, "only")], "id long, name string")
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id long")
    none = spark.createDataFrame([], "query_id long, id long, score double")
    signals = {m: none for m in fusion.WEIGHTS}
    assert rows(fusion.hybrid(q, items, signals, 3)) == [(i, 1, 7, 1.0) for i in range(5)]
    assert fusion.hybrid(q, items, signals, 0).count() == 0
    answers = spark.createDataFrame([(1, "only", 2), (1, "gone", 0)], "query_id long, name string, rank int")
    assert rows(fusion.named_ranks(answers, items)) == [(1, 7, 2)]


def test_names_edges_and_even_activation(spark):
    schema = "id long, name string, text string, requires array<string>, complements array<string>"
    items = spark.createDataFrame([(0, "auth", "a b", [], ["Rev"]), (1, "api-review", "a c", ["auth", "api-review"], ["nope"]), (2, "review", "", ["API"], [])], schema)
    wanted = spark.createDataFrame([("auth",), ("REVIEW",), ("zzz",), (None,)], "wanted string")
    assert rows(graph.resolve_names(wanted, items)) == [("REVIEW", 1, "api-review"), ("auth", 0, "auth")]
    edges = graph.declared_edges(items, X.tokens)
    assert {(r[0], r[1], r[2]) for r in edges.collect()} == {("api-review", "auth", "depends_on"), ("review", "api-review", "depends_on"), ("auth", "api-review", "complements")}
    assert edges.filter("type = 'complements'").first()["w"] == pytest.approx(0.3 + 0.7 / 3)
    assert dict(rows(graph.edge_counts(edges))) == {"complements": 1, "depends_on": 2}
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    start = spark.createDataFrame([(1, 0, 0.5)], "query_id long, id long, score double")
    links = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    got = {(r[0], r[1]): r[2] for r in graph.spread_all(q, start, items, 3, links).collect()}
    alone = {r[1]: r[2] for r in graph.spread(start, links).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == alone
    assert got[2, 2] == pytest.approx(1 / 3) and got[2, 0] == got[2, 1] == pytest.approx((1 + 0.5 + 0.125 + 0.015625) / 3)
    complements = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    made = {r["id"]: r for r in graph.typed_spread(start, complements, spark.createDataFrame([(0, 2)], "src long, dst long")).collect()}
    assert made[0]["score"] == 1.0 and made[2]["required"] and made[2]["score"] == pytest.approx(0.7)


def test_feature_neighbours_are_the_nearest_pairs(spark):
    v = spark.createDataFrame([(i, f"f{k}", float(1 + (i * k) % 5)) for i in range(12) for k in range(4) if (i + k) % 3], "id long, feature string, w double")
    want = {(a, b): round(w, 9) for a, b, w in rows(graph.nearest(graph.pair_cosines(v).withColumn("w", F.round("w", 12)), 3))}
    assert {(a, b): round(w, 9) for a, b, w in rows(graph.feature_neighbours(v, 3))} == want
    assert graph.feature_neighbours(v.filter("false"), 3).count() == 0


def test_complements_are_the_first_names(spark):
    names = spark.createDataFrame([(f"go-{i:02d}",) for i in range(20)], "name string")
    got = {}
    for a, b, _ in graph.typed_edges(names).collect():
        got.setdefault(a, []).append(b)
    every = [f"go-{i:02d}" for i in range(20)]
    assert {a: sorted(b) for a, b in got.items()} == {a: [x for x in every if x != a][:5] for a in every}


def test_extraction_and_report(spark):
    lex = {"broad": {"data": ["dataset", "pipelines"], "other": ["zzz"]}, "precise": {}}
    assert discovery.broad_category(["pipeline", "datasets", "x1"], lex) == "data" and discovery.broad_category(["pipeline"], lex) is None
    items = spark.createDataFrame([(1, "datasets pipeline tool"), (2, "")], "id long, text string")
    got = {r["id"]: r for r in discovery.extract_items(items, lex).collect()}
    assert (got[1]["key"], got[1]["keywords"], got[1]["broad"]) == ("datasets", ["datasets", "pipeline", "tool"], "data")
    assert (got[2]["key"], got[2]["broad"]) == ("feat_2", None)
    docs = spark.createDataFrame([(i, "kubernetes cluster deploy" if i % 2 else "react component render") for i in range(40)], "id long, text string")
    merged, report = discovery.discover_report(docs, {"broad": {"deploying": ["deploy"]}, "precise": {}})
    assert report["discovered"] == {"broad": 2, "precise": 0} and report["recommendation"] in ("good", "usable", "poor") and "deploying" in merged["broad"]


def test_notes_and_files(spark, tmp_path):
    assert markdown.directories_of(" /a:/b::/a", ["/c"]) == ["/a", "/b"] and markdown.directories_of("", ["/c"]) == ["/c"]
    notes = spark.createDataFrame([("Query Plans!", "db", NOW, ["x", "y"], ["plans are trees"], []), ("Empty", None, None, None, None, None)], "title string, domain string, date timestamp, tags array<string>, findings array<string>, sources array<string>")
    markdown.write_notes(notes, str(tmp_path / "notes"))
    text = {r["note"]: r["value"] for r in spark.read.text(str(tmp_path / "notes"), wholetext=True).collect()}
    assert text["query_plans"].startswith("---\ndomain: db\n") and "- plans are trees" in text["query_plans"] and set(text) == {"query_plans", "empty"}
    folder = tmp_path / "k"
    folder.mkdir()
    (folder / "join-order.md").write_text("---\ndomain: db\ntags: a\n---\n# Title\n> quote\nJoins are reordered.\n")
    (folder / "misc.md").write_text("Notes on join order in tables")
    found = markdown.load_notes(spark, [str(folder)])
    assert {r["summary"] for r in found.collect()} == {"Joins are reordered.", "Notes on join order in tables"}
    got = markdown.search_notes(found, "join order").collect()
    assert [(r["priority"], r["path"].rpartition("/")[2]) for r in got] == [(0, "join-order.md"), (1, "misc.md")]
    assert markdown.search_notes(found, "join order", search_body=False).count() == 1
    general = found.filter("domain = ''").withColumn("path", F.lit("/g/join-order-general.md"))
    assert [r["priority"] for r in markdown.search_notes(found.filter("domain = 'db'"), "join order", general=general, tech_words=["TABLES"]).collect()] == [0, 2]
    (folder / "p.py").write_text("x = 1")
    made = {r["path"].rpartition("/")[2]: r for r in markdown.read_sources(spark, [str(folder / n) for n in ("p.py", "misc.md", "gone.py")]).collect()}
    assert made["p.py"]["value"] == "x = 1" and made["misc.md"]["error"] == "no program text" and made["gone.py"]["error"] == "no such file"
    assert [r["path"].rpartition("/")[2] for r in markdown.source_files(spark, [str(folder)]).collect()] == ["p.py"]
    assert markdown.recent_files(spark, [str(folder)], datetime.now()).count() == 2 and markdown.recent_files(spark, [str(folder)], datetime.now() + timedelta(days=9)).count() == 0
    (folder / "deep" / "deeper").mkdir(parents=True)
    (folder / "deep" / "SKILL.md").write_text("---\nname: near\n---\nlong enough for an item")
    (folder / "deep" / "deeper" / "SKILL.md").write_text("---\nname: far\n---\nlong enough for an item")
    assert [r["name"] for r in markdown.load_plugin_items(spark, [str(folder), str(tmp_path / "gone")]).collect()] == ["near"]
    (tmp_path / "bad.json").write_text("{[")
    for load in (markdown.load_rules, markdown.load_triggers, markdown.load_labelled_queries):
        assert load(spark, str(tmp_path / "bad.json")).count() == load(spark, str(tmp_path / "missing.json")).count() == 0
    log = str(tmp_path / "log")
    assert store.read_log(spark, log, commands.CORRECTIONS).count() == 0
    store.append_log(spark.createDataFrame([("q", "a", 1.0, NOW)], commands.CORRECTIONS), log)
    (tmp_path / "log" / "torn.parquet").write_text("half")
    assert store.read_log(spark, log, commands.CORRECTIONS).count() == 1
    store.clear_log(spark, log, commands.CORRECTIONS)
    assert store.read_log(spark, log, commands.CORRECTIONS).count() == 0
    store.write_report({"a": 1}, spark, str(tmp_path / "r"))
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect())) == {"a": 1}
    store.write_lexicon({"broad": {"f": list("zyxwvutsrqponm")}}, spark, str(tmp_path / "lex"))
    assert spark.read.json(str(tmp_path / "lex")).first()["terms"] == sorted("zyxwvutsrqponm")[:12]


def test_logs_and_counts(spark):
    log = spark.createDataFrame([("a", "s", 1.0, NOW), ("a", "s", 1.0, NOW - timedelta(days=60)), ("b", "s", 1.0, NOW - timedelta(days=31))], commands.CORRECTIONS)
    assert [r["qhash"] for r in feedback.prune(log, NOW).collect()] == ["a", "a"]
    seen = spark.createDataFrame([("q", "a", 2, 1), ("q", "b", 1, 2), ("r", "a", 1, 3)], commands.OBSERVATIONS)
    assert tuple(feedback.observation_stats(seen).first()) == (2, 4, 3)
    made, watched = Router.learn(spark.createDataFrame([("do it", "x")], "query string, preferred string"), NOW)
    assert made.first()["skill"] == watched.first()["skill"] == "x" and made.first()["ts"] == NOW and watched.first()["weight"] == 1
    asked = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "query_id long, expected array<string>")
    ranked = spark.createDataFrame([(1, 1, "a"), (2, 1, "x"), (2, 3, "b"), (3, 4, "c")], "query_id long, rank int, name string")
    assert tuple(evaluate.self_test(asked, ranked).first()) == (3, 1, 1)
    held = spark.createDataFrame([("n", "a long description"), ("m", None)], "name string, description string")
    assert rows(evaluate.self_test_sample(held, None, 6)) == [("n", "a long", ["n"])]
    assert X.clamp_method(" Cosine ", ["cosine", "hybrid"]) == "cosine" and X.clamp_method("x", ["cosine"]) == "hybrid"
    assert set(spark.createDataFrame([("parseHTTPFile_name",)], "t string").select(X.symbol_parts(F.col("t"), ["name"])).first()[0]) == {"parse", "http", "file"}
    words, terms = (spark.createDataFrame([(w,) for w in ws], f"{c} string") for ws, c in ((["x" * 20000, "pythn"], "word"), (["python"], "term")))
    from quillrank.operators import routing

    assert rows(routing.corrections(words, terms)) == [("pythn", "python", 1)]
    candidates = bm25.rerank_candidates(spark.createDataFrame([(1, 5, 0.5)], "query_id long, id long, score double"), spark.createDataFrame([(5, "five")], "id long, name string"))
    assert rows(candidates) == [(1, 1, 5, "five", 0.5)]


def test_stream_posteriors_equal_the_batch(spark, tmp_path):
    schema = "qhash string, skill string, weight int, seq long"
    log = spark.createDataFrame([("q", "a", 2, 1), ("q", "b", 1, 2), ("q", "a", 1, 3), ("r", "a", 1, 4), ("q", "c", 4, 5)], schema)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = events.live_posteriors(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("posteriors").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    exact = lambda df: sorted((r["qhash"], r["skill"], r["alpha"], round(r["beta"], 9)) for r in df.collect())
    assert exact(spark.table("posteriors")) == exact(feedback.live_posteriors(log))


def test_saved_router_service_and_commands(spark, tmp_path):
    items = spark.createDataFrame([(i, f"skill-{i}", " ".join(["common"] + ["security"] * (i % 3 == 0) + ["python"] * (i % 4 == 0)), f"body {i}") for i in range(12)] + [(12, "bare", "", "b")], "id long, name string, text string, body string")
    lex = {"broad": {"security": ["security"]}, "precise": {"python": ["python"]}}
    made = Router(items, lex)
    made.save(str(tmp_path / "index"))
    r = Router.load(spark, str(tmp_path / "index"))
    assert r.status() == made.status() and r.lexicon == lex and r.postings.n == 13 and r.postings.avgdl == made.postings.avgdl
    q = spark.createDataFrame([(1, "python security")], "query_id long, query string")
    best = rows(r.rank(q, 3))
    assert best == rows(made.rank(q, 3)) and best[0][3] == "skill-0"
    said = spark.createDataFrame([(1, "do it", "python security")], "query_id long, query string, description string")
    assert [x["skill"] for x in r.correct(said, NOW, least=0.0).collect()] == ["skill-0"] and r.correct(said, NOW, least=9.9).count() == 0
    outside = spark.createDataFrame([(1, "skill-7", 0)], "query_id long, name string, rank int")
    plain = {x["name"]: x["score"] for x in r.query(q, 13).collect()}
    moved = {x["name"]: x["score"] for x in r.query(q, 13, extra_ranks=outside).collect()}
    assert moved["skill-7"] - plain["skill-7"] == pytest.approx(1 / 60) and moved["skill-3"] - plain["skill-3"] == pytest.approx(1 / 73)
    s = Service(r)
    got = [json.loads(x) for x in s.lines(['{"query": "python security", "k": 2, "body": true}', "not json", "", '{"op": "compare", "query": "python", "names": ["skill-4", "none"]}', '{"op": "nope"}', '{"op": "health"}'])]
    assert [x["name"] for x in got[0]["results"]][0] == "skill-0" and got[0]["results"][0]["body"] == "body 0" and "error" in got[1]
    assert [(x["name"], x["known"]) for x in got[2]["items"]][0] == ("skill-4", True) and "error" in got[3] and got[4]["answered"] == 2
    server = s.http()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as f:
        assert json.load(f)["status"] == "ok"
    server.shutdown()
    run = lambda *w: commands.run(spark, commands.arguments().parse_args(list(w)))
    path = str(tmp_path / "rules.json")
    assert run("rule", path, "add", "py.*", "skill-1") == [{"pattern": "py.*", "skill": "skill-1"}] and run("rule", path, "remove", "0") == [] == run("rule", path, "list")
    assert run("learn", str(tmp_path / "c"), str(tmp_path / "o"), "do it", "skill-2") == {"learned": "skill-2"}
    assert run("feedback", str(tmp_path / "c"))["entries"] == 1
    n = len(tables._written)
    assert n and tables.clean(spark) <= n and not tables._written


def test_vectors_of_named_features(spark):
    df = spark.createDataFrame([(1, "broad", "x"), (2, "broad", "x")], "id long, tier string, feature string")
    stats = vectors.feature_stats(df, 4)
    assert rows(stats.select("feature", "df", "coverage")) == [("x", 2, 0.5)]
