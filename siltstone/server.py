"""HTTP over one Database: POST /sql, /explain and /cancel, GET /health and /tables, JSON both ways.

    POST /sql      {"sql": ..., "format": "rows" | "columns", "limit": n, "timeout": seconds}
    POST /explain  {"sql": ..., "run": true}
    POST /cancel   stops the query that runs

Statements run one at a time, in the order in which they arrive, each as a job group of its own, so that a timeout or
/cancel stops its tasks and nothing else. A result goes through the driver: one of over `most_rows` rows is an error of
kind `too_large`, not a shortened answer.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import AnalysisException, ParseException

from .api import Database

MOST_ROWS = 1_000_000


class Stopped(Exception):
    pass


class TooLarge(Exception):
    pass


def plain(v):
    """A value as JSON has it; what JSON has no form for is text, and a number that isn't finite is null."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return v.decode("utf-8", "replace")
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


class Service:
    def __init__(self, db: Database, timeout: float | None = None, most_rows: int = MOST_ROWS):
        self.db, self.timeout, self.most_rows = db, timeout, most_rows
        self.queries, self.began = 0, time.monotonic()
        self._worker = ThreadPoolExecutor(1, "siltstone-sql")
        self._lock, self._group, self._why = threading.Lock(), None, None

    def _stop(self, why: str, group: str | None = None) -> bool:
        """Stops the query that runs, or only the one of `group`."""
        with self._lock:
            if self._group is None or group not in (None, self._group):
                return False
            self._why = why
            # with later jobs of the group, so that a query between two jobs stops as well
            self.db.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self._group)
            return True

    def _run(self, work, sql: str, timeout: float | None):
        context, group = self.db.spark.sparkContext, uuid.uuid4().hex
        with self._lock:
            self._group, self._why = group, None
        timer = threading.Timer(timeout, self._stop, (f"timeout after {timeout} s", group)) if timeout else None
        try:
            context.setJobGroup(group, sql[:200], interruptOnCancel=True)
            if timer:
                timer.start()
            made = work()
        except Exception as e:
            if self._why:
                raise Stopped(self._why) from e
            raise
        finally:
            if timer:
                timer.cancel()
            with self._lock:
                self._group = None
        if self._why:
            raise Stopped(self._why)
        return made

    def _sql(self, asked: dict) -> dict:
        cursor, limit = self.db.execute(asked["sql"]), asked.get("limit")
        rows = cursor.fetchmany(int(limit) if limit else self.most_rows + 1)
        if len(rows) > self.most_rows:
            raise TooLarge(f"more than {self.most_rows} rows")
        names = [d[0] for d in cursor.description]
        rows = [[plain(v) for v in r] for r in rows]
        if asked.get("format") == "columns":
            return {"names": names, "count": len(rows), "columns": [list(c) for c in zip(*rows)] if rows else [[] for _ in names]}
        return {"names": names, "count": len(rows), "rows": rows}

    def _explain(self, asked: dict) -> dict:
        return {"plan": self.db.explain(asked["sql"], analyze=bool(asked.get("run", True)))}

    def get(self, path: str) -> tuple[int, dict]:
        if path == "/health":
            return 200, {"ok": True, "db": self.db.store.root, "queries": self.queries, "uptime": round(time.monotonic() - self.began, 1)}
        if path == "/tables":
            return 200, {"tables": sorted(self.db.tables())}
        return 404, {"error": "no such path", "kind": "error"}

    def post(self, path: str, asked: dict) -> tuple[int, dict]:
        if path == "/cancel":
            return 200, {"ok": True, "stopped": self._stop("cancelled")}
        work = {"/sql": self._sql, "/explain": self._explain}.get(path)
        if work is None:
            return 404, {"error": "no such path", "kind": "error"}
        asked = {**asked, "sql": (asked.get("sql") or "").strip().rstrip(";")}
        if not asked["sql"]:
            return 400, {"error": "empty sql", "kind": "error"}
        began = time.perf_counter()
        try:
            timeout = float(asked.get("timeout") or self.timeout or 0) or None
            told = self._worker.submit(self._run, lambda: work(asked), asked["sql"], timeout).result()
        except Stopped as e:
            return 200, {"error": str(e), "kind": "timeout"}
        except TooLarge as e:
            return 200, {"error": str(e), "kind": "too_large"}
        except ParseException as e:
            return 200, {"error": str(e)[:400], "kind": "syntax"}
        except (AnalysisException, KeyError, ValueError) as e:
            return 200, {"error": str(e)[:400], "kind": "error"}
        except Exception as e:
            return 500, {"error": f"{type(e).__name__}: {str(e)[:400]}", "kind": "failed"}
        self.queries += 1
        return 200, {**told, "wall": round(time.perf_counter() - began, 4)}


def server(db: Database, host: str = "127.0.0.1", port: int = 8765, timeout: float | None = None, most_rows: int = MOST_ROWS) -> ThreadingHTTPServer:
    """A server that serve_forever() starts and shutdown() ends; port 0 takes a free one."""
    service = Service(db, timeout, most_rows)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _send(self, status: int, told: dict) -> None:
            body = json.dumps(told, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self._send(*service.get(self.path))

        def do_POST(self):
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(asked, dict):
                    raise ValueError("not an object")
            except ValueError as e:
                return self._send(400, {"error": f"bad JSON: {e}", "kind": "error"})
            self._send(*service.post(self.path, asked))

    made = ThreadingHTTPServer((host, port), Handler)
    made.daemon_threads = True
    made.service = service
    return made
