"""Single requests, one query at a time, as the JSON of a search page, and a small HTTP server for them.

A request is a batch of one: the tables of the index and the suggestions are built once and kept in the shared folder.
"""

from __future__ import annotations

import json
import time
from functools import cached_property
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicons as L
from .operators import suggest
from .operators.baseline import old_search
from .operators.search import search
from .plans.index import Index, build_index
from .scratch import written
from .sources.catalogue import payload, read_catalogue, request_numbers

PAGE = """<!doctype html><meta charset="utf-8"><title>Search</title>
<form onsubmit="event.preventDefault(); fetch('/api/search?q=' + encodeURIComponent(q.value)).then(r => r.json()).then(r => out.textContent = JSON.stringify(r, null, 1))">
<input id="q" autofocus><button>Search</button></form><pre id="out"></pre>
"""


def milliseconds(since: float) -> float:
    return round(1000 * (time.perf_counter() - since), 2)


class Service:
    def __init__(self, index: Index, log: DataFrame | None = None):
        self.index, self.log = index, log
        self.spark: SparkSession = index.cards.sparkSession

    @classmethod
    def of_file(cls, spark: SparkSession, path: str, log: DataFrame | None = None) -> Service:
        return cls(build_index(read_catalogue(spark, path)), log)

    @cached_property
    def phrases(self) -> DataFrame:
        return written(suggest.build(self.index, self.log), "phrases")

    @cached_property
    def completions(self) -> suggest.Completions:
        return suggest.completions(self.phrases)

    def cards(self, results: DataFrame) -> list[dict]:
        return [json.loads(r.json) for r in payload(self.index, results).orderBy("rank").collect()]  # as many as the request's limit

    def search(self, raw: str, limit: str | None = None, boost: str | None = None, both: bool = False) -> dict:
        """The new engine's answer, and with both the baseline's. A limit or boost that is no number is the default."""
        began = time.perf_counter()
        numbers = request_numbers(self.spark.createDataFrame([(limit, boost)], "limit string, boost string")).first()
        asked = self.spark.createDataFrame([("q", raw)], "query_id string, raw string")
        found = written(search(self.index, asked, numbers["limit"], boost=numbers["boost"]), "answer")
        head = found.where("rank = 1").first()
        about = {k: head[k] if head else None for k in ("strategy", "message", "fallback")}
        out = {"query": raw, "new": {"results": self.cards(found), **about}}
        if both:
            old = written(old_search(self.index, asked, numbers["limit"]), "old-answer")
            first = old.first()
            out["old"] = {"results": self.cards(old.withColumn("why", F.lit(""))), "total": first.n if first else 0}
        return out | {"ms": milliseconds(began)}

    def suggest(self, typed: str) -> dict:
        began = time.perf_counter()
        rows = suggest.suggest(self.completions, self.spark.createDataFrame([("t", typed)], "typed_id string, typed string"), L.SUGGEST_LIMIT)
        return {"q": typed, "suggestions": [r.phrase for r in rows.orderBy("rank").collect()], "ms": milliseconds(began)}

    def answer(self, target: str) -> tuple[int, str, str]:
        """Status, content type and body for a request's path and parameters."""
        at = urlsplit(target)
        one = {k: v[0] for k, v in parse_qs(at.query).items()}
        if at.path == "/api/search":
            return 200, "application/json", json.dumps(self.search(one.get("q", ""), one.get("limit"), one.get("boost"), one.get("mode") == "both"))
        if at.path == "/api/suggest":
            return 200, "application/json", json.dumps(self.suggest(one.get("q", "")))
        if at.path in ("/", "/index.html"):
            return 200, "text/html; charset=utf-8", PAGE
        return 404, "text/plain; charset=utf-8", "not found\n"


def served(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not running yet; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, body = service.answer(self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
