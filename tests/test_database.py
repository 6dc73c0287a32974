import datetime

import pytest

from siltstone import cli
from siltstone.api import Database
from siltstone.sources import readers


@pytest.fixture()
def db(spark, tmp_path):
    return Database.create(spark, f"{tmp_path}/db")


def rows(db, sql):
    return sorted(db.execute(sql).fetchall(), key=str)


def changed(db, sql):
    return db.run(sql).first()[0]


def test_insert_select_and_defaults(db):
    db.run("CREATE TABLE t (a BIGINT, b VARCHAR DEFAULT 'none', c DOUBLE)")
    assert changed(db, "INSERT INTO t VALUES (1, 'x', 1.5), (2, NULL, 2.5)") == 2
    assert changed(db, "INSERT INTO t (c, a) VALUES (9, 3)") == 1
    assert rows(db, "SELECT * FROM t") == [(1, "x", 1.5), (2, None, 2.5), (3, "none", 9.0)]
    assert changed(db, "INSERT INTO t SELECT a + 10, b, c FROM t WHERE a < 3") == 2
    assert rows(db, "SELECT COUNT(*), SUM(a) FROM t") == [(5, 29)]
    with pytest.raises(ValueError):
        db.run("INSERT INTO t VALUES (1)")


def test_delete_keeps_unknown(db):
    db.run("CREATE TABLE t (a BIGINT, b VARCHAR)")
    db.run("INSERT INTO t VALUES (1, 'x'), (2, NULL), (3, 'y')")
    assert changed(db, "DELETE FROM t WHERE b = 'x' OR b = 'z'") == 1
    assert rows(db, "SELECT a FROM t") == [(2,), (3,)]
    assert changed(db, "DELETE FROM t WHERE a > 99") == 0
    assert changed(db, "DELETE FROM t") == 2
    assert rows(db, "SELECT * FROM t") == []


def test_update_is_simultaneous(db):
    db.run("CREATE TABLE t (a BIGINT, b BIGINT)")
    db.run("INSERT INTO t VALUES (1, 10), (2, 20), (NULL, 30)")
    assert changed(db, "UPDATE t SET a = b, b = a WHERE a >= 1") == 2
    assert rows(db, "SELECT * FROM t") == [(10, 1), (20, 2), (None, 30)]
    with pytest.raises(ValueError):
        db.run("UPDATE t SET z = 1")


def test_changes_leave_other_segments(db):
    db.run("CREATE TABLE t (a BIGINT)")
    for k in range(3):
        db.run(f"INSERT INTO t VALUES ({k}), ({k + 10})")
    before = [s["path"] for s in db.store.tables["t"]["segments"]]
    db.run("UPDATE t SET a = a + 100 WHERE a = 1")
    after = [s["path"] for s in db.store.tables["t"]["segments"]]
    assert len(set(before) & set(after)) == 2
    assert rows(db, "SELECT SUM(a) FROM t") == [(136,)]


def test_alter(db):
    db.run("CREATE TABLE t (a BIGINT)")
    db.run("INSERT INTO t VALUES (1)")
    db.run("ALTER TABLE t ADD COLUMN b VARCHAR DEFAULT 'd'")
    db.run("INSERT INTO t VALUES (2, 'e')")
    assert rows(db, "SELECT * FROM t") == [(1, "d"), (2, "e")]
    db.run("ALTER TABLE t RENAME COLUMN b TO c")
    db.run("ALTER TABLE t DROP COLUMN a")
    assert rows(db, "SELECT * FROM t") == [("d",), ("e",)]
    db.run("ALTER TABLE t ADD COLUMN a BIGINT")
    assert rows(db, "SELECT a FROM t") == [(None,), (None,)]
    db.run("ALTER TABLE t RENAME TO u")
    assert list(db.tables()) == ["u"]
    db.run("DROP TABLE u")
    db.run("DROP TABLE IF EXISTS u")
    assert db.store.vacuum() >= 1 and db.tables() == {}


def test_reopen_and_maintenance(spark, db):
    db.run("CREATE TABLE t (a BIGINT, d DATE)")
    for k in (3, 1, 2):
        db.run(f"INSERT INTO t VALUES ({k}, DATE '2024-01-0{k}')")
    again = Database.open(spark, db.store.root)
    assert rows(again, "SELECT a FROM t") == [(1,), (2,), (3,)]
    assert again.compact("t", cluster_by=["a"]) == 3
    again.retype("t", {"a": "double"})
    again.set_table_mode("t", "buffered")
    again.flush("t")
    db.refresh()
    assert rows(db, "SELECT a, d FROM t WHERE a < 2") == [(1.0, datetime.date(2024, 1, 1))]
    assert {r["column"]: r["nulls"] for r in db.stats("t").collect()} == {"a": 0, "d": 0}


def test_cursor(db):
    db.run("CREATE TABLE t (a BIGINT, b VARCHAR)")
    db.run("INSERT INTO t VALUES (1, 'x'), (2, 'y'), (3, 'z')")
    cursor = db.execute("SELECT a, b FROM t ORDER BY a")
    assert cursor.fetchone() == (1, "x") and cursor.fetchmany(1) == [(2, "y")] and cursor.fetchall() == [(3, "z")]
    assert [d[0] for d in cursor.description] == ["a", "b"]
    assert db.run_columnar("SELECT a FROM t ORDER BY a")["a"].tolist() == [1, 2, 3]
    assert [len(b) for b in db.stream("SELECT a FROM t", 2)] == [2, 1]
    assert db.execute("SELECT a FROM t").arrow().num_rows == 3
    assert sum(b.num_rows for b in db.execute("SELECT a FROM t").fetch_record_batch(2)) == 3
    assert list(db.execute("SELECT a FROM t").df()["a"]) and "Scan" in db.explain("SELECT a FROM t")


def test_stored_distinct_counts(db):
    db.run("CREATE TABLE t (g VARCHAR, v BIGINT)")
    db.run("INSERT INTO t VALUES ('a', 1), ('a', 1), ('a', 2), ('b', 5), (NULL, 7)")
    db.materialize_gd("t", "g", "v")
    assert sorted(map(tuple, db.gd_inspect("t", "g", "v").collect()), key=str) == [("a", 2, 3), ("b", 1, 1), (None, 1, 1)]
    assert db.gd_trim("t", "g", "v", ["b", None]) == 2


def test_foreign_key(db):
    db.run("CREATE TABLE p (k BIGINT)")
    db.run("CREATE TABLE c (f BIGINT)")
    db.run("INSERT INTO p VALUES (1), (2)")
    db.run("INSERT INTO c VALUES (1), (NULL)")
    db.create_fk_pointer("c", "f", "p", "k")
    db.run("INSERT INTO c VALUES (9)")
    with pytest.raises(ValueError):
        db.create_fk_pointer("c", "f", "p", "k")


def test_load_formats_and_casts(spark, tmp_path):
    df = spark.createDataFrame([(1, 19000, 1700000000), (2, 19001, None)], "a bigint, d int, t bigint")
    for kind in ("csv", "json", "orc", "parquet", "tsv"):
        readers.write(df, f"{tmp_path}/x.{kind}", kind)
        back = readers.read(spark, f"{tmp_path}/x.{kind}", kind if kind in ("csv", "tsv", "json") else None)
        assert readers.same_rows(readers.cast_columns(back, {"a": "bigint", "d": "int", "t": "bigint"}).select("a", "d", "t"), df)
    out = readers.load(spark, f"{tmp_path}/x.parquet", f"{tmp_path}/y", {"d": "date_days", "t": "timestamp_s"}, cluster_by=["d"])
    assert out.dtypes == [("a", "bigint"), ("d", "date"), ("t", "timestamp_ntz")]
    assert out.filter("a = 1").first()["t"] == datetime.datetime(2023, 11, 14, 22, 13, 20)
    db = Database.create(spark, f"{tmp_path}/db")
    assert db.load("t", f"{tmp_path}/x.parquet", {"d": "date_days"}) == 2


def test_command_line(spark, tmp_path, capsys):
    root = f"{tmp_path}/db"
    script = tmp_path / "a.sql"
    script.write_text("CREATE TABLE t (a BIGINT, b VARCHAR); INSERT INTO t VALUES (1, 'x;y');")
    assert cli.main([root, "init"]) == 0
    assert cli.main([root, "file", str(script)]) == 0
    capsys.readouterr()
    for kind, said in (("csv", "a,b\n1,x;y\n"), ("json", '{"a": 1, "b": "x;y"}\n')):
        cli.main([root, "--format", kind, "sql", "SELECT * FROM t"])
        assert capsys.readouterr().out.replace("\r", "") == said
    cli.main([root, "tables"])
    assert "t a bigint, b string" in capsys.readouterr().out
