"""Requests as plain dictionaries over a warm router: answered one by one, from standard input, or over HTTP.

A Spark query takes a second or so however small it is, so this is for tools that ask now and then;
many queries belong in one table for `Router.query`.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions import text as X
from quillrank.operators import evaluate
from quillrank.plans.router import METHODS, Router


class Service:
    """handle({"op": ..., ...}) -> answer. Requests: query (query, k, method, body), compare (query, names), plan (query, k), keywords (text), status, health."""

    def __init__(self, router: Router, rules: DataFrame | None = None):
        self.router, self.rules = router, rules
        self.answered = self.failed = 0
        self.seconds = 0.0

    def _asked(self, query: str) -> DataFrame:
        return self.router.items.sparkSession.createDataFrame([(0, str(query or ""))], "query_id int, query string")

    def _query(self, r: dict) -> dict:
        k, method = X.clamp_k(r.get("k", 5)), X.clamp_method(r.get("method"), [*METHODS, "hybrid"])
        body = bool(r.get("body")) and "body" in self.router.items.columns
        found = self.router.query(self._asked(r.get("query")), k, method, rules=self.rules, body=body).orderBy("rank").collect()
        return {"method": method, "results": [{"rank": x["rank"], "name": x["name"], "score": round(x["score"], 4)} | ({"body": x["body"]} if body else {}) for x in found]}

    def _compare(self, r: dict) -> dict:
        q = self._asked(r.get("query"))
        names = q.select("query_id", F.explode(F.array(*[F.lit(str(n)) for n in r.get("names", [])]).cast("array<string>")).alias("name"))
        of_items = self.router.features.join(self.router.items.select("id", "name"), "id").select("name", "feature").distinct()
        of_query = self.router.query_features(q).select(F.col("id").alias("query_id"), "feature").distinct()
        made = evaluate.compare(of_query, of_items, names, self.router.rank(q, 10)).collect()
        return {"items": [x.asDict() | {"score": round(x["score"], 4), "jaccard": round(x["jaccard"], 4)} for x in made]}

    def _plan(self, r: dict) -> dict:
        made = self.router.plan(self._asked(r.get("query")), X.clamp_k(r.get("k", 5))).orderBy("pos").collect()
        return {"steps": [x["name"] for x in made if x["resolved"]], "unresolved": [x["name"] for x in made if not x["resolved"]]}

    def _keywords(self, r: dict) -> dict:
        words = self._asked(r.get("text")).select(X.code_keywords(F.col("query")).alias("w")).first()["w"]
        return {"keywords": words} | self._query({"query": " ".join(words), "k": r.get("k", 5)})

    def handle(self, request: dict) -> dict:
        """The answer, or {"error": ...}; an unknown request is an error."""
        began = time.time()
        known = {"query": self._query, "compare": self._compare, "plan": self._plan, "keywords": self._keywords, "status": lambda r: self.router.status(), "health": lambda r: self.health()}
        try:
            made = known[request.get("op", "query")](request)
        except Exception as e:  # whatever a request does wrong, the next one is answered
            self.failed += 1
            return {"error": f"{type(e).__name__}: {e}"[:500]}
        self.answered += 1
        self.seconds += time.time() - began
        return made | {"ms": round(1000 * (time.time() - began), 1)}

    def health(self) -> dict:
        """Requests answered and failed, and the mean time of an answer."""
        return {"status": "ok", "answered": self.answered, "failed": self.failed, "mean_ms": round(1000 * self.seconds / max(self.answered, 1), 1)}

    def lines(self, requests: Iterable[str]) -> Iterator[str]:
        """One JSON answer for each JSON line."""
        for line in requests:
            if line.strip():
                try:
                    asked = json.loads(line)
                    yield json.dumps(self.handle(asked if isinstance(asked, dict) else {"op": None}), ensure_ascii=False)
                except json.JSONDecodeError as e:
                    yield json.dumps({"error": f"no JSON: {e}"})

    def http(self, port: int = 0, host: str = "127.0.0.1") -> HTTPServer:
        """A server, not yet running, with /query (GET or POST), /health and /stats."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, made: dict, code: int = 200) -> None:
                raw = json.dumps(made, ensure_ascii=False).encode()
                self.send_response(code if "error" not in made else 400)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def do_GET(self) -> None:
                at = urlsplit(self.path)
                asked = {k: v[0] for k, v in parse_qs(at.query).items()}
                op = {"/query": "query", "/health": "health", "/stats": "status"}.get(at.path)
                self.answer(service.handle(asked | {"op": op}) if op else {"error": "no such page"})

            def do_POST(self) -> None:
                try:
                    asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                except json.JSONDecodeError:
                    asked = None
                self.answer(service.handle(asked) if isinstance(asked, dict) else {"error": "no JSON object"})

            def log_message(self, *_) -> None:
                pass

        return HTTPServer((host, port), Handler)
