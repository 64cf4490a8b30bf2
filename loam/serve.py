"""Search over HTTP: /, /health and /search/<query>, with a limit of requests and allowed origins."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession

from loam.operators.rank import search
from loam.plans.store import latest_index
from loam.sources.tables import Settings

FIELDS = ["title", "og_title", "desc", "favicon", "url"]
METHODS, HEADERS = "GET, POST, PUT, PATCH, DELETE, OPTIONS", "Accept, Authorization, Content-Type, X-CSRF-Token"


class Limit:
    """At most n requests a key within any span of seconds."""

    def __init__(self, n: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.n, self.seconds, self.clock = n, seconds, clock
        self.times: dict[str, deque] = {}
        self.lock = threading.Lock()

    def admits(self, key: str) -> bool:
        now = self.clock()
        with self.lock:
            for k in [k for k, t in self.times.items() if t[-1] <= now - self.seconds]:
                del self.times[k]
            t = self.times.setdefault(key, deque())
            while t and t[0] <= now - self.seconds:
                t.popleft()
            if len(t) >= self.n:
                return False
            t.append(now)
            return True


def searcher(spark: SparkSession, root: str) -> Callable[[str], list[dict]]:
    """Answers queries from the newest index in a folder; only the best pages' fields reach the driver."""
    index, pages = latest_index(spark, root), spark.read.parquet(f"{root}/pages")
    return lambda query: [{f: r[f] or "" for f in FIELDS} for r in search(index, pages, query).select(*FIELDS).collect()]


def make_server(answer: Callable[[str], list[dict]], settings: Settings) -> ThreadingHTTPServer:
    limit = Limit(settings.requests_a_minute)

    class Handler(BaseHTTPRequestHandler):
        def say(self, status: int, body=None) -> None:
            raw = b"" if body is None else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            if self.headers.get("Origin") in settings.allowed_origins:
                for name, value in {"Origin": self.headers["Origin"], "Methods": METHODS, "Headers": HEADERS, "Credentials": "true"}.items():
                    self.send_header(f"Access-Control-Allow-{name}", value)
                self.send_header("Access-Control-Max-Age", "300")
            self.send_header("Vary", "Origin")
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.say(204)

        def do_GET(self) -> None:  # noqa: N802
            if not limit.admits(self.client_address[0]):
                return self.say(429, {"error": "too many requests"})
            path = urlsplit(self.path).path
            if path == "/":
                return self.say(200, "search API")
            if path.rstrip("/") == "/health":
                return self.say(200, {"status": "ok"})
            if path.startswith("/search/") and path.strip("/").count("/") == 1:
                try:
                    return self.say(200, answer(unquote(path.strip("/").split("/")[1])))
                except Exception as e:  # one bad request must not end the service
                    self.log_error("%r", e)
                    return self.say(500, {"error": "search failed"})
            self.say(404, {"error": "not found"})

        def log_message(self, form: str, *args) -> None:
            pass

    return ThreadingHTTPServer((settings.host, settings.port), Handler)
