"""Commands over a directory of Markdown items: python -m quillrank COMMAND ...

build DIR... --index P --lexicon F   parse items and save a router's tables below P
query P TEXT [-k N] [--method M] [--rules F]   ranked items        plan P TEXT [-k N]   ordered steps
eval P QUERIES [--method M]          MRR and Hit@k of labelled queries      self-test P [--sample N]
stats P                              sizes of the index              edges P   typed edges by kind
correct P LOG QUERY DESCRIPTION      append a correction            feedback LOG   what corrections hold
learn LOG OBSERVED QUERY NAME        append a correction and an observation
discover DIR... --lexicon F --out P  discover features, merge and judge them
rule F list|add|remove ...           edit a rule file               serve P [--http PORT]   answer requests
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CORRECTIONS, OBSERVATIONS = "qhash string, skill string, boost double, ts timestamp", "qhash string, skill string, weight int, seq long"


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillrank", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *names, **options):
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n, **({"nargs": "+"} if n == "dirs" else {}))
        for flag, default in options.items():
            p.add_argument(f"--{flag}", default=default, type=type(default) if default is not None else str)
        return p

    command("build", "dirs", index="quillrank-index", lexicon=None)
    command("query", "index", "text", k=5, method="hybrid", rules=None)
    command("plan", "index", "text", k=5)
    command("eval", "index", "queries", k=5, method="hybrid")
    command("self-test", "index", sample=20)
    command("stats", "index")
    command("edges", "index")
    command("correct", "index", "log", "text", "description")
    command("learn", "log", "observed", "text", "name")
    command("feedback", "log")
    command("discover", "dirs", lexicon=None, out=None)
    command("rule", "file", "action").add_argument("rest", nargs="*")
    command("serve", "index", http=0)
    return top


def rule_file(path: str, action: str, rest: list[str]) -> list[dict]:
    """The rules after the edit. add PATTERN SKILL, remove PLACE, list."""
    try:
        with open(path) as f:
            rules = json.load(f)
    except (FileNotFoundError, json.JSONDecodeError):
        rules = []
    if action == "add":
        rules.append({"pattern": rest[0], "skill": rest[1]})
    elif action == "remove":
        del rules[int(rest[0])]
    elif action != "list":
        raise SystemExit(f"unknown action {action}")
    if action != "list":
        with open(path, "w") as f:
            json.dump(rules, f, ensure_ascii=False, indent=1)
    return rules


def run(spark: SparkSession, a: argparse.Namespace) -> dict | list:
    """What a command prints."""
    from quillrank.functions import lexicon as L
    from quillrank.operators import discovery, evaluate, feedback, graph
    from quillrank.plans.router import Router
    from quillrank.service import Service
    from quillrank.sources import markdown, store

    now = datetime.now()
    if a.command == "rule":
        return rule_file(a.file, a.action, a.rest)
    if a.command == "feedback":
        return feedback.book_stats(feedback.error_book(store.read_log(spark, a.log, CORRECTIONS), now), now).first().asDict()
    if a.command == "learn":
        said = spark.createDataFrame([(a.text, a.name)], "query string, preferred string")
        for events, path in zip(Router.learn(said, now), (a.log, a.observed)):
            store.append_log(events, path)
        return {"learned": a.name}
    if a.command in ("build", "discover"):
        lexicon = L.read_lexicon(spark, a.lexicon) if a.lexicon else L.sample_lexicon()
        items = markdown.load_items(spark, a.dirs).withColumnRenamed("search_text", "text")
        if a.command == "build":
            held = items.select("id", "name", "text", "description", "body", "meta.requires", "meta.complements", "meta.provides", "meta.needs")
            Router(held, lexicon).save(a.index)
            return Router.load(spark, a.index).status()
        merged, report = discovery.discover_report(items, lexicon)
        if a.out:
            store.write_lexicon({t: fs for t, fs in merged.items()}, spark, f"{a.out}/lexicon")
            store.write_report(report, spark, f"{a.out}/report")
        return report
    r = Router.load(spark, a.index)
    one = lambda text: spark.createDataFrame([(0, text)], "query_id int, query string")
    if a.command == "query":
        return Service(r, markdown.load_rules(spark, a.rules) if a.rules else None).handle({"query": a.text, "k": a.k, "method": a.method})
    if a.command == "plan":
        return Service(r).handle({"op": "plan", "query": a.text, "k": a.k})
    if a.command == "eval":
        asked = markdown.load_labelled_queries(spark, a.queries)
        return evaluate.mrr_hit(asked, r.rank(asked.select("query_id", "query"), a.k, a.method), a.k).first().asDict()
    if a.command == "self-test":
        asked = evaluate.self_test_sample(r.items, a.sample or None)
        return evaluate.self_test(asked, r.rank(asked.select("query_id", "query"), 3)).first().asDict()
    if a.command == "stats":
        return r.status()
    if a.command == "edges":
        return {x["type"]: x["edges"] for x in graph.edge_counts(graph.typed_edges(r.items)).collect()}
    if a.command == "correct":
        made = r.correct(one(a.text).withColumn("description", F.lit(a.description)), now).collect()
        if made:
            store.append_log(spark.createDataFrame(made, CORRECTIONS), a.log)
        return {"corrected": made[0]["skill"] if made else None}
    service = Service(r)
    if a.http:
        service.http(a.http).serve_forever()
    for line in service.lines(sys.stdin):
        print(line, flush=True)
    return service.health()


def main(words: list[str] | None = None) -> None:
    a = arguments().parse_args(words)
    spark = SparkSession.builder.appName("quillrank").getOrCreate()
    print(json.dumps(run(spark, a), ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()
