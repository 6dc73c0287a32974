"""Queries over files, changeable tables and the database facade. Each works in a folder of its own and returns what is
there afterwards, which the SQL beside it computes from the tables as they are."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import threading
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..api import Database
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import statistics as T
from ..server import server
from ..sources import readers
from ..sources.scratch import folder
from ..sources.tables import table
from .frames import query


def _database(spark: SparkSession, d: str, *tables: str) -> Database:
    db = Database.create(spark, folder(spark, "db"))
    for t in tables:
        db.load(t, f"{d}/{t}.parquet")
    return db


@query("SELECT n_nationkey AS k, n_name AS name, src FROM nation, (VALUES ('csv'), ('json'), ('tsv')) v(src)")
def src_csv_json(spark, d):
    nation, root, out = table(spark, d, "nation"), folder(spark, "files"), None
    for kind in ("csv", "json", "tsv"):
        readers.write(nation, f"{root}/nation.{kind}", kind)
        one = readers.read(spark, f"{root}/nation.{kind}").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name"), F.lit(kind).alias("src"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, DATE '1970-01-01' + CAST(o_orderkey % 9000 AS INTEGER) AS day, LENGTH(o_orderpriority) AS priority_length FROM orders")
def src_load(spark, d):
    root = folder(spark, "load")
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9000).alias("day"), F.col("o_orderpriority").alias("priority"))
    readers.write(orders, f"{root}/source")
    out = readers.load(spark, f"{root}/source", f"{root}/target", casts={"day": "date_days"}, hash_by=["o_orderkey"], row_lengths=["priority"], format="parquet")
    return out.select("o_orderkey", "day", "priority_length")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000")
def src_cluster_slice(spark, d):
    """Files and row groups of other ranges aren't read."""
    target = f"{folder(spark, 'slice')}/orders"
    laid = readers.load(spark, f"{d}/orders.parquet", target, cluster_by=["o_totalprice"])
    return laid.filter(F.col("o_totalprice").between(100000, 110000)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders WHERE o_orderkey > 100 GROUP BY o_orderstatus")
def src_segments(spark, d):
    root = folder(spark, "segments")
    for k in range(3):
        readers.write(table(spark, d, "orders").filter(F.col("o_orderkey") % 3 == k), f"{root}/{k}")
    whole = readers.read_many(spark, [f"{root}/{k}" for k in range(3)]).filter("o_orderkey > 100")
    return whole.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def src_segments_join(spark, d):
    """A fact table of several segments under a join."""
    root = folder(spark, "segments")
    for k in range(3):
        readers.write(table(spark, d, "lineitem").filter(F.col("l_linenumber") % 3 == k), f"{root}/{k}")
    fact = readers.read_many(spark, [f"{root}/{k}" for k in range(3)])
    return table(spark, d, "orders").join(fact, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
def df_merge_distinct(spark, d):
    whole = table(spark, d, "lineitem")
    return A.merge_distinct([whole.filter("l_orderkey % 2 = 0"), whole.filter("l_orderkey % 2 <> 0")], ["l_returnflag"], "l_suppkey").select("l_returnflag", F.col("distinct_count").alias("suppliers"), F.col("row_count").alias("n"))


@query("SELECT c_nationkey AS k, ROUND(SUM(c_acctbal), 2) AS s, sink FROM customer, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) v(sink) GROUP BY c_nationkey, sink")
def src_sinks(spark, d):
    made, root, out = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("s")), folder(spark, "sinks"), None
    for kind in ("csv", "json", "orc", "parquet"):
        readers.write(made, f"{root}/{kind}", kind)
        one = readers.read(spark, f"{root}/{kind}", kind).select(F.col("k").cast("int").alias("k"), F.col("s").cast("double").alias("s"), F.lit(kind).alias("sink"))
        out = one if out is None else out.unionByName(one)
    return out


_CURSOR = "SELECT n_nationkey AS k, n_name AS name FROM nation ORDER BY n_nationkey"


@query("SELECT n_nationkey AS k, n_name AS name, way FROM nation, (VALUES ('one'), ('many'), ('all'), ('iterated'), ('batches'), ('numpy'), ('pandas')) v(way)")
def api_cursor(spark, d):
    """Every way to take rows from a cursor."""
    db, rows = _database(spark, d, "nation"), []
    cursor = db.execute(_CURSOR)
    while (row := cursor.fetchone()) is not None:
        rows.append((*row, "one"))
    cursor = db.execute(_CURSOR)
    while block := cursor.fetchmany(4):
        rows += [(*r, "many") for r in block]
    rows += [(*r, "all") for r in db.execute(_CURSOR).fetchall()]
    rows += [(*r, "iterated") for r in db.execute(_CURSOR)]
    for batch in db.execute(_CURSOR).fetch_record_batch(7):
        rows += [(r["k"], r["name"], "batches") for r in batch.to_pylist()]
    held = db.execute(_CURSOR).fetchnumpy()
    rows += [(int(k), str(n), "numpy") for k, n in zip(held["k"], held["name"])]
    rows += [(int(k), n, "pandas") for k, n in db.execute(_CURSOR).df().itertuples(index=False)]
    return spark.createDataFrame(rows, "k int, name string, way string")


@query("SELECT s_suppkey AS k, s_acctbal AS b FROM supplier WHERE s_acctbal > 0")
def api_columnar(spark, d):
    held = _database(spark, d, "supplier").run_columnar("SELECT s_suppkey AS k, s_acctbal AS b FROM supplier WHERE s_acctbal > 0")
    return spark.createDataFrame(list(zip(held["k"].tolist(), held["b"].tolist())), "k long, b double")


@query("SELECT p_partkey AS k, p_size AS z FROM part WHERE p_size > 45")
def api_stream(spark, d):
    blocks = _database(spark, d, "part").stream("SELECT p_partkey AS k, p_size AS z FROM part WHERE p_size > 45", 100)
    return spark.createDataFrame([r for block in blocks for r in block if len(block) <= 100], "k long, z int")


@query("SELECT COUNT(*) AS rows, TRUE AS timed, TRUE AS pushed FROM lineitem WHERE l_quantity > 40")
def api_explain(spark, d):
    db = Database.create(spark, folder(spark, "db"))
    db.register("lineitem", f"{d}/lineitem.parquet")
    told = db.explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40", analyze=True)
    seen = json.loads(told.splitlines()[0])
    return spark.createDataFrame([(seen["rows"], seen["seconds"] > 0, "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in told)], "rows long, timed boolean, pushed boolean")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x', 1.5::DOUBLE, DATE '2024-02-29', TRUE), (2, NULL, NULL, NULL, FALSE)) v(a, b, c, e, f)")
def ddl_create(spark, d):
    db = _database(spark, d)
    db.run("CREATE TABLE t (a BIGINT, b VARCHAR, c DOUBLE, e DATE, f BOOLEAN)")
    db.run("INSERT INTO t VALUES (1, 'x', 1.5, DATE '2024-02-29', TRUE), (2, NULL, NULL, NULL, FALSE)")
    return db.run("SELECT * FROM t")


@query("SELECT n_nationkey AS k, n_name AS title, CAST(7 AS BIGINT) AS grade FROM nation")
def ddl_alter(spark, d):
    db = _database(spark, d, "nation")
    for sql in ("ALTER TABLE nation ADD COLUMN grade BIGINT DEFAULT 7", "ALTER TABLE nation RENAME COLUMN n_name TO title", "ALTER TABLE nation DROP COLUMN n_regionkey", "ALTER TABLE nation RENAME TO places"):
        db.run(sql)
    return db.run("SELECT n_nationkey AS k, title, grade FROM places")


@query("SELECT 'region' AS name, COUNT(*) AS rows FROM region")
def ddl_drop(spark, d):
    db = _database(spark, d, "nation", "region")
    db.run("DROP TABLE nation")
    db.run("DROP TABLE IF EXISTS nation")
    rows = [(name, db.spark.table(name).count()) for name in db.tables()]
    return spark.createDataFrame(rows, "name string, rows long")


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS b FROM customer UNION ALL VALUES (-1, 'new', 0.5), (-2, NULL, 9.0) UNION ALL SELECT c_custkey + 1000000, 'none', c_acctbal FROM customer WHERE c_acctbal < 0")
def dml_insert(spark, d):
    db = Database.create(spark, folder(spark, "db"))
    db.register("customer", f"{d}/customer.parquet")
    db.run("CREATE TABLE t (k BIGINT, name VARCHAR DEFAULT 'none', b DOUBLE)")
    db.run("INSERT INTO t SELECT c_custkey, c_name, c_acctbal FROM customer")
    db.run("INSERT INTO t VALUES (-1, 'new', 0.5), (-2, NULL, 9.0)")
    db.run("INSERT INTO t (k, b) SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_acctbal < 0")
    return db.run("SELECT k, name, b FROM t")


@query("SELECT o_orderkey AS k, (SELECT COUNT(*) FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'F') AS removed FROM orders WHERE NOT (o_totalprice > 150000 OR o_orderstatus = 'F')")
def dml_delete(spark, d):
    db = _database(spark, d, "orders")
    removed = db.run("DELETE FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'F'").first()[0]
    return db.run(f"SELECT o_orderkey AS k, CAST({removed} AS BIGINT) AS removed FROM orders")


@query("SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN s_nationkey ELSE s_suppkey END AS a, CASE WHEN s_acctbal < 0 THEN s_acctbal + s_suppkey ELSE s_acctbal END AS b FROM supplier")
def dml_update(spark, d):
    """All right sides see the row as it was."""
    db = _database(spark, d, "supplier")
    db.run("ALTER TABLE supplier ADD COLUMN a BIGINT")
    db.run("UPDATE supplier SET a = s_suppkey")
    db.run("UPDATE supplier SET a = s_nationkey, s_acctbal = s_acctbal + a WHERE s_acctbal < 0")
    return db.run("SELECT s_suppkey AS k, a, s_acctbal AS b FROM supplier")


@query("SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c, CAST(1 AS BIGINT) AS segments FROM orders WHERE o_orderkey < 2000 UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), 1 FROM orders WHERE o_orderkey >= 2000")
def dml_maintenance(spark, d):
    db = Database.create(spark, folder(spark, "db"))
    db.register("orders", f"{d}/orders.parquet")
    db.run("CREATE TABLE t AS SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey < 2000")
    db.run("INSERT INTO t SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 2000")
    db.flush("t")
    db.compact("t")
    db.recluster("t", "k")
    db.retype("t", {"c": "string"})
    db.store.vacuum()
    return db.run(f"SELECT k, c, CAST({len(db.store.tables['t']['segments'])} AS BIGINT) AS segments FROM t")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT)), (2, 0, 1), (3, 0, 1)) v(a, buffered, flushed)")
def dml_buffered(spark, d):
    """Rows inserted in buffered mode are one segment after flush()."""
    db = _database(spark, d)
    db.run("CREATE TABLE t (a BIGINT)")
    db.set_table_mode("t", "buffered")
    for k in (1, 2, 3):
        db.run(f"INSERT INTO t VALUES ({k})")
    before, seen = len(db.store.tables["t"]["segments"]), db.run("SELECT a FROM t").count()
    db.flush("t")
    return db.run(f"SELECT a, CAST({before} AS BIGINT) AS buffered, CAST({len(db.store.tables['t']['segments'])} AS BIGINT) AS flushed FROM t WHERE {seen} = 3")


@query("SELECT * FROM (VALUES ('n_regionkey', TRUE), ('n_nationkey', FALSE)) v(child, valid)")
def api_fk_pointer(spark, d):
    db, rows = _database(spark, d, "nation", "region"), []
    for child in ("n_regionkey", "n_nationkey"):
        try:
            db.create_fk_pointer("nation", child, "region", "r_regionkey")
            rows.append((child, True))
        except ValueError:
            rows.append((child, False))
    return spark.createDataFrame(rows, "child string, valid boolean")


@query("SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 1) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def df_fk_join(spark, d):
    lineitem, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    J.check_foreign_key(lineitem, "l_orderkey", orders, "o_orderkey")
    joined = lineitem.join(orders.filter("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("r"))


_PLACES = "(SELECT n_regionkey, r_name, n_regionkey % 2 AS odd FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_PAIRS = [(a, b) for a in ("n_regionkey", "r_name", "odd") for b in ("n_regionkey", "r_name", "odd") if a != b]


@query(" UNION ALL ".join(f"SELECT '{a}' AS determinant, '{b}' AS dependent WHERE (SELECT MAX(n) FROM (SELECT COUNT(DISTINCT {b}) AS n FROM {_PLACES} p GROUP BY {a}) g) = 1" for a, b in _PAIRS))
def stat_dependencies(spark, d):
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    places = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    places = places.select("n_regionkey", "r_name", (F.col("n_regionkey") % 2).alias("odd"))
    return spark.createDataFrame(T.discover_dependencies(places, 0.5), "determinant string, dependent string")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS "distinct", CAST(MIN({c}) AS VARCHAR) AS least, CAST(MAX({c}) AS VARCHAR) AS greatest FROM (SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) AS n_regionkey FROM nation) t""" for c in ("n_nationkey", "n_name", "n_regionkey")))
def stat_columns(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 2)").alias("n_regionkey"))
    return T.column_statistics(nation, exact=True).select("column", "rows", "nulls", "distinct", "least", "greatest")


@query("SELECT * FROM (VALUES ('copy', TRUE), ('changed', FALSE), ('repeated', FALSE)) v(what, same)")
def src_verify(spark, d):
    orders, path = table(spark, d, "orders"), f"{folder(spark, 'verify')}/orders"
    readers.load(spark, f"{d}/orders.parquet", path, cluster_by=["o_custkey"])
    copy = spark.read.parquet(path)
    changed = copy.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice")))
    found = [("copy", copy), ("changed", changed), ("repeated", copy.unionByName(copy.limit(1)))]
    return spark.createDataFrame([(what, readers.same_rows(orders, df)) for what, df in found], "what string, same boolean")


@query("SELECT n_regionkey AS k, COUNT(*) AS n, TRUE AS held FROM nation GROUP BY n_regionkey")
def api_prewarm(spark, d):
    db = _database(spark, d, "nation")
    db.prewarm("nation")
    held = db.spark.catalog.isCached("nation")
    rows = db.execute("SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey").fetchall()
    db.spark.catalog.uncacheTable("nation")
    return spark.createDataFrame([(k, n, held) for k, n in rows], "k int, n long, held boolean")


@query("SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey > 1 ORDER BY 1")
def cli_session(spark, d):
    """init, load, sql, compact, recluster, retype and stats by the command line."""
    from .. import cli

    root = folder(spark, "db")

    def told(*args: str) -> str:
        options, rest = (args[:2], args[2:]) if args[0] == "--format" else ((), args)
        with contextlib.redirect_stdout(io.StringIO()) as out:
            cli.main([*options, root, *rest])
        return out.getvalue()

    told("init")
    told("load", "region", f"{d}/region.parquet", "--hash", "r_regionkey", "--row-lengths", "r_name")
    told("recluster", "region", "r_regionkey")
    told("retype", "region", "r_name_length=string")
    told("compact", "region")
    assert "r_regionkey" in told("tables") and "r_regionkey" in told("stats", "region")
    rows = list(csv.reader(io.StringIO(told("--format", "csv", "sql", "SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey > 1 ORDER BY 1"))))
    return spark.createDataFrame([(int(k), name) for k, name in rows[1:]], "k int, name string")


@query("SELECT n_regionkey AS k, COUNT(*) AS n, (SELECT COUNT(*) FROM nation) AS inserted, 'nation,t' AS tables FROM nation GROUP BY n_regionkey")
def api_server(spark, d):
    """A table made, filled and read over HTTP."""
    made = server(_database(spark, d, "nation"), port=0)
    threading.Thread(target=made.serve_forever, daemon=True).start()

    def ask(path: str, **body):
        data = json.dumps(body).encode() if body else None
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{made.server_port}{path}", data)) as f:
            return json.load(f)

    try:
        ask("/sql", sql="CREATE TABLE t (k BIGINT)")
        inserted = ask("/sql", sql="INSERT INTO t SELECT n_regionkey FROM nation")["rows"][0][0]
        rows = ask("/sql", sql="SELECT k, COUNT(*) AS n FROM t GROUP BY k")["rows"]
        tables = ",".join(ask("/tables")["tables"])
    finally:
        made.shutdown()
        made.server_close()
    return spark.createDataFrame([(k, n, inserted, tables) for k, n in rows], "k int, n long, inserted long, tables string")


@query("SELECT l_returnflag, l_linestatus, MEDIAN(l_extendedprice) AS m, QUANTILE_DISC(l_partkey, 0.25) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def df_quantiles(spark, d):
    """No task holds the values of a group."""
    wanted = {"m": (F.col("l_extendedprice"), 0.5, True), "q": (F.col("l_partkey"), 0.25, False)}
    return A.quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], wanted)


@query("SELECT event_type, COUNT(DISTINCT user_id) AS distinct_count, COUNT(*) AS row_count FROM events WHERE event_type <> 'click' GROUP BY event_type")
def api_group_distinct(spark, d):
    db = Database.create(spark, folder(spark, "db"))
    db.register("events", f"{d}/events.parquet")
    db.materialize_gd("events", "event_type", "user_id")
    db.gd_trim("events", "event_type", "user_id", ["click"])
    return db.gd_inspect("events", "event_type", "user_id")
