import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from siltstone.api import Database
from siltstone.server import plain, server

SLOW = "SELECT COUNT(*) FROM range(4000000) a, range(4000000) b WHERE a.id * b.id % 7 = 9"


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    db = Database.create(spark, str(tmp_path_factory.mktemp("server")))
    made = server(db, port=0, most_rows=50)
    threading.Thread(target=made.serve_forever, daemon=True).start()

    def ask(path, body=None, raw=None):
        data = raw if raw is not None else None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{made.server_port}{path}", data)) as f:
                return f.status, json.load(f)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    yield ask
    made.shutdown()
    made.server_close()


def test_statements(ask):
    assert ask("/sql", {"sql": "CREATE TABLE t (a BIGINT, b DATE, c DOUBLE)"})[0] == 200
    assert ask("/sql", {"sql": "INSERT INTO t VALUES (1, DATE '2024-02-29', 0.5), (2, NULL, NULL);"})[1]["rows"] == [[2]]
    told = ask("/sql", {"sql": "SELECT * FROM t ORDER BY a"})[1]
    assert (told["names"], told["rows"], told["count"]) == (["a", "b", "c"], [[1, "2024-02-29", 0.5], [2, None, None]], 2)
    assert ask("/sql", {"sql": "SELECT a FROM t ORDER BY a", "format": "columns", "limit": 1})[1]["columns"] == [[1]]
    assert ask("/sql", {"sql": "SELECT a FROM t WHERE a > 9", "format": "columns"})[1]["columns"] == [[]]
    assert ask("/tables")[1] == {"tables": ["t"]}
    assert ask("/health")[1]["queries"] >= 4
    assert "Physical Plan" in ask("/explain", {"sql": "SELECT a FROM t"})[1]["plan"]


def test_errors(ask):
    assert ask("/sql", {"sql": "SELEC 1"})[1]["kind"] == "syntax"
    assert ask("/sql", {"sql": "SELECT nothing FROM nowhere"})[1]["kind"] == "error"
    assert ask("/sql", {"sql": " ; "})[0] == 400
    assert ask("/sql", raw=b"{")[0] == 400
    assert ask("/sql", raw=b"[1]")[0] == 400
    assert ask("/other", {})[0] == 404 and ask("/other")[0] == 404
    assert ask("/sql", {"sql": "SELECT id FROM range(51)"})[1]["kind"] == "too_large"
    assert ask("/sql", {"sql": "SELECT id FROM range(50)"})[1]["count"] == 50


def test_timeout_and_cancel(ask):
    began = time.monotonic()
    assert ask("/sql", {"sql": SLOW, "timeout": 1})[1]["kind"] == "timeout"
    assert ask("/cancel", {})[1]["stopped"] is False
    stopper = threading.Timer(1, lambda: ask("/cancel", {}))
    stopper.start()
    assert ask("/sql", {"sql": SLOW})[1]["error"] == "cancelled"
    assert time.monotonic() - began < 60
    assert ask("/sql", {"sql": "SELECT 1"})[1]["rows"] == [[1]]


def test_one_at_a_time(ask):
    told = []
    threads = [threading.Thread(target=lambda k=k: told.append(ask("/sql", {"sql": f"SELECT {k}"})[1]["rows"][0][0])) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(told) == list(range(6))


def test_values_without_a_form():
    assert plain([float("nan"), b"x\xff", {1: float("inf")}]) == [None, "x\ufffd", {"1": None}]
