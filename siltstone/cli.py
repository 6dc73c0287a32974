"""python -m siltstone.cli DB COMMAND ...: init, load, sql, file, shell, explain, tables, stats, audit, compact, recluster, retype, flush, vacuum, serve."""

from __future__ import annotations

import argparse
import csv
import json
import sys

from pyspark.sql import DataFrame

from .api import Database
from .operators import statistics
from .server import server
from .session import session


def emit(df: DataFrame, kind: str) -> None:
    """Row by row, so a result need not fit into memory."""
    out = sys.stdout
    if kind == "table":
        out.write(df._jdf.showString(1000, 60, False))
        return
    if kind in ("csv", "tsv"):
        w = csv.writer(out, delimiter="\t" if kind == "tsv" else ",")
        w.writerow(df.columns)
        w.writerows(tuple(r) for r in df.toLocalIterator())
        return
    for r in df.toLocalIterator():
        out.write(json.dumps(r.asDict(), default=str, ensure_ascii=False) + "\n")


def statements(script: str) -> list[str]:
    out, quoted = [""], False
    for c in script:
        if c == "'":
            quoted = not quoted
        if c == ";" and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [s.strip() for s in out if s.strip()]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    p.add_argument("db")
    p.add_argument("--format", choices=("table", "csv", "tsv", "json"), default="table")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    for name, given in {"init": [], "tables": [], "shell": [], "vacuum": [], "sql": ["text"], "explain": ["text"], "file": ["path"], "stats": ["table"], "audit": ["table"], "compact": ["table"], "flush": ["table"], "recluster": ["table", "key"], "retype": ["table"], "load": ["table", "path"], "serve": []}.items():
        s = sub.add_parser(name)
        for g in given:
            s.add_argument(g)
        if name == "load":
            s.add_argument("--cluster-by", nargs="+")
            s.add_argument("--hash", nargs="+", metavar="COLUMN")
            s.add_argument("--row-lengths", nargs="+", metavar="COLUMN")
            s.add_argument("--cast", nargs="+", default=[], metavar="COLUMN=CAST")
        if name == "explain":
            s.add_argument("--analyze", action="store_true")
        if name == "serve":
            s.add_argument("--host", default="127.0.0.1")
            s.add_argument("--port", type=int, default=8765)
            s.add_argument("--timeout", type=float, metavar="SECONDS")
        if name == "retype":
            s.add_argument("casts", nargs="+", metavar="COLUMN=CAST")
    a = p.parse_args(args)
    spark = session(master=a.master)
    db = Database(spark, a.db, create=a.command == "init")
    if a.command == "load":
        print(db.load(a.table, a.path, dict(c.split("=", 1) for c in a.cast), a.cluster_by, hash_by=a.hash, row_lengths=a.row_lengths))
    elif a.command == "sql":
        emit(db.run(a.text), a.format)
    elif a.command == "file":
        with open(a.path) as f:
            for s in statements(f.read()):
                emit(db.run(s), a.format)
    elif a.command == "explain":
        print(db.explain(a.text, analyze=a.analyze))
    elif a.command == "tables":
        for name, columns in db.tables().items():
            print(name, ", ".join(f"{c} {k}" for c, k in columns))
    elif a.command == "stats":
        emit(db.stats(a.table), a.format)
    elif a.command == "audit":
        for x, y in statistics.discover_dependencies(db.spark.table(a.table), 1.0):
            print(f"{x} -> {y}")
    elif a.command == "compact":
        print(db.compact(a.table))
    elif a.command == "recluster":
        db.recluster(a.table, a.key)
    elif a.command == "retype":
        db.retype(a.table, dict(c.split("=", 1) for c in a.casts))
    elif a.command == "flush":
        db.flush(a.table)
    elif a.command == "vacuum":
        print(db.store.vacuum())
    elif a.command == "serve":
        server(db, a.host, a.port, a.timeout).serve_forever()
    elif a.command == "shell":
        for line in sys.stdin:
            for s in statements(line):
                emit(db.run(s), a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
