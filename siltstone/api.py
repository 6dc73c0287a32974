"""Database: tables in a folder and SQL over them.

    db = Database.create(spark, "/data/db")
    db.run("CREATE TABLE t (a BIGINT, b VARCHAR)")
    db.run("INSERT INTO t VALUES (1, 'x')")
    db.run("SELECT b, COUNT(*) FROM t GROUP BY b").show()
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .functions import sqlfront
from .functions.sqlfront import Group, find, nest, split, text, tokens, upper
from .operators import statistics
from .sources import readers
from .sources.store import Store


class Cursor:
    """Over a result: rows as tuples, or columns."""

    def __init__(self, df: DataFrame):
        self._df, self._rows = df, None
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.fetchone()) is not None:
            yield row

    def _next(self) -> Iterator:
        if self._rows is None:
            self._rows = self._df.toLocalIterator(prefetchPartitions=True)
        return self._rows

    def fetchone(self) -> tuple | None:
        row = next(self._next(), None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int = 1) -> list[tuple]:
        return [r for r in (self.fetchone() for _ in range(size)) if r is not None]

    def fetchall(self) -> list[tuple]:
        if self._rows is None:
            return [tuple(r) for r in self._df.collect()]
        return list(self)

    def arrow(self) -> pa.Table:
        return self._df.toArrow()

    def fetch_record_batch(self, rows: int = 65_536) -> pa.RecordBatchReader:
        """Batch by batch, a partition at a time in the driver's memory."""
        schema = to_arrow_schema(self._df.schema)

        def batches():
            while block := self.fetchmany(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)

        return pa.RecordBatchReader.from_batches(schema, batches())

    def fetchnumpy(self) -> dict[str, np.ndarray]:
        table = self.arrow()
        return {n: table.column(n).to_numpy(zero_copy_only=False) for n in table.column_names}

    def df(self):
        return self._df.toPandas()


class Database:
    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.spark = spark.newSession()  # views and settings of its own
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.store = Store(self.spark, root, create)
        self._views: set[str] = set()
        self._pending: dict[str, list[DataFrame]] = {}  # rows of VALUES given to tables in buffered mode, until flush()
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Database:
        return cls(spark, root, True)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Database:
        return cls(spark, root)

    def refresh(self) -> None:
        """Takes up what others changed."""
        self.store.refresh()
        for view in self._views - set(self.store.tables):
            self.spark.catalog.dropTempView(view)
        for name in self.store.tables:
            whole = self.store.read(name)
            for rows in self._pending.get(name, []):
                whole = whole.unionByName(rows)
            whole.createOrReplaceTempView(name)
        self._views = set(self.store.tables)

    def register(self, name: str, path: str, format: str | None = None) -> None:
        """A file as a table that is only read."""
        readers.read(self.spark, path, format).createOrReplaceTempView(name)

    def tables(self) -> dict[str, list[list[str]]]:
        return {n: t["columns"] for n, t in self.store.tables.items()}

    # queries

    def run(self, sql: str) -> DataFrame:
        """A query's result; of a change, one row with the number of rows changed."""
        nodes = nest(tokens(sql.strip().rstrip(";")))
        word = upper(nodes[0])
        if word in ("CREATE", "DROP", "ALTER", "INSERT", "DELETE", "UPDATE"):
            if word != "INSERT":
                for name in list(self._pending):  # a change sees every row
                    self._flush(name)
            changed = getattr(self, "_" + word.lower())(nodes)
            self.refresh()
            return self.spark.createDataFrame([(changed,)], "changed long")
        return sqlfront.run(self.spark, sql)

    def execute(self, sql: str) -> Cursor:
        return Cursor(self.run(sql))

    def run_columnar(self, sql: str) -> dict[str, np.ndarray]:
        return self.execute(sql).fetchnumpy()

    def stream(self, sql: str, block_rows: int = 65_536) -> Iterator[list[tuple]]:
        """The result block by block, a partition at a time in the driver's memory."""
        cursor = self.execute(sql)
        while block := cursor.fetchmany(block_rows):
            yield block

    def explain(self, sql: str, mode: str = "formatted", analyze: bool = False) -> str:
        """The plan; with `analyze` the query runs, and a line of JSON comes first: rows and seconds."""
        df = self.run(sql)
        if analyze:
            began = time.perf_counter()
            seen = Observation("explain")
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            told = {"rows": seen.get["rows"], "seconds": round(time.perf_counter() - began, 6)}
            return json.dumps(told) + "\n" + self.explain(sql, mode)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # changes

    def _create(self, n: Group) -> int:
        if upper(n[1]) != "TABLE":
            raise ValueError("CREATE TABLE is what can be created")
        if find(n, "AS") >= 0:
            at = find(n, "AS")
            df = self.spark.sql(sqlfront.translate(text(n[at + 1 :])))
            self.store.create(n[2], df.dtypes)
            return self.store.append(n[2], df)
        columns, defaults = [], {}
        for c in split(n[3]):
            kind, at = c[1:], find(c, "DEFAULT")
            if at >= 0:
                kind, defaults[c[0]] = c[1:at], sqlfront.translate(text(c[at + 1 :]))
            columns.append((c[0], self._type(kind)))
        self.store.create(n[2], columns, defaults)
        return 0

    @staticmethod
    def _type(kind: list) -> str:
        word = upper(kind[0])
        if word in ("DECIMAL", "NUMERIC", "DOUBLE", "FLOAT", "REAL"):
            return "double"
        if word in ("TINYINT", "SMALLINT", "INTEGER", "INT", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"):
            return "bigint"
        if word in ("CHAR", "VARCHAR", "TEXT", "STRING"):
            return "string"
        if word in ("TIMESTAMP", "DATETIME", "TIMESTAMP_NTZ"):
            return "timestamp_ntz"
        if word in ("DATE", "BOOLEAN", "BOOL"):
            return "boolean" if word.startswith("BOOL") else "date"
        raise ValueError(f"type {text(kind)} can't be stored")

    def _drop(self, n: Group) -> int:
        if upper(n[2]) == "IF":
            self.store.drop(n[4], True)
        else:
            self.store.drop(n[2])
        return 0

    def _alter(self, n: Group) -> int:
        name, rest = n[2], n[3:]
        if upper(rest[0]) == "ADD":
            rest = rest[2:] if upper(rest[1]) == "COLUMN" else rest[1:]
            at = find(rest, "DEFAULT")
            default = sqlfront.translate(text(rest[at + 1 :])) if at >= 0 else None
            self.store.add_column(name, rest[0], self._type(rest[1 : at if at >= 0 else None]), default)
        elif upper(rest[0]) == "RENAME" and upper(rest[1]) == "TO":
            self.store.rename(name, rest[2])
        elif upper(rest[0]) == "RENAME":
            old, _, new = rest[2:5] if upper(rest[1]) == "COLUMN" else rest[1:4]
            self.store.rename_column(name, old, new)
        elif upper(rest[0]) == "DROP":
            self.store.drop_column(name, rest[2] if upper(rest[1]) == "COLUMN" else rest[1])
        else:
            raise ValueError(f"ALTER TABLE {text(rest)}")
        return 0

    def _insert(self, n: Group) -> int:
        name, rest = n[2], n[3:]
        columns = None
        if isinstance(rest[0], Group) and find(rest[0], "SELECT") < 0:
            columns, rest = [c[0] for c in split(rest[0])], rest[1:]
        df = self.spark.sql(sqlfront.translate(text(rest)))
        if upper(rest[0]) == "VALUES" and self.store._table(name)["mode"] == "buffered":
            df = self.store.fitted(name, df, columns)
            self._pending.setdefault(name, []).append(df)
            return df.count()
        return self.store.append(name, df, columns)

    def _delete(self, n: Group) -> int:
        return self.store.delete(n[2], self._where(n[3:]))

    def _update(self, n: Group) -> int:
        at = find(n, "WHERE")
        values = {}
        for item in split(n[3 : at if at >= 0 else None]):
            values[item[0]] = sqlfront.translate(text(item[2:]))
        return self.store.update(n[1], values, self._where(n[at:] if at >= 0 else []))

    @staticmethod
    def _where(nodes: list) -> str | None:
        return sqlfront.translate(text(nodes[1:])) if nodes and upper(nodes[0]) == "WHERE" else None

    # loading and maintenance

    def load(self, name: str, path: str, casts: dict[str, str] | None = None, cluster_by: list[str] | None = None, format: str | None = None, hash_by: list[str] | None = None, row_lengths: list[str] | None = None) -> int:
        df = readers.prepared(readers.read(self.spark, path, format), casts, cluster_by, hash_by, row_lengths)
        if name not in self.store.tables:
            self.store.create(name, df.dtypes)
        rows = self.store.append(name, df)
        self.refresh()
        return rows

    def flush(self, name: str) -> None:
        """Rows that wait in buffered mode become one segment; in segment mode inserts are segments at once."""
        self.store._table(name)
        self._flush(name)
        self.refresh()

    def _flush(self, name: str) -> None:
        waiting = self._pending.pop(name, [])
        if waiting:
            self.store.append(name, functools.reduce(DataFrame.unionByName, waiting))

    def set_table_mode(self, name: str, mode: str) -> None:
        """segment: each INSERT writes a segment. buffered: rows of INSERT ... VALUES wait in this Database, seen by its
        own queries only and lost with it, until flush(), any other change or compaction writes them as one."""
        self._flush(name)
        self.store.set_mode(name, mode)
        self.refresh()

    def compact(self, name: str, files: int | None = None, cluster_by: list[str] | None = None) -> int:
        self._flush(name)
        before = self.store.compact(name, files, cluster_by)
        self.refresh()
        return before

    def recluster(self, name: str, key: str) -> None:
        self.compact(name, cluster_by=[key])

    def retype(self, name: str, casts: dict[str, str]) -> None:
        self._flush(name)
        self.store.retype(name, casts)
        self.refresh()

    def prewarm(self, name: str | None = None) -> None:
        for t in [name] if name else list(self.store.tables):
            self.spark.catalog.cacheTable(t)

    def create_fk_pointer(self, child: str, column: str, parent: str, key: str) -> None:
        """Checks what a pointer rests on: the parent's key is unique and every child has its parent."""
        from .operators import joins

        joins.check_foreign_key(self.spark.table(child), column, self.spark.table(parent), key)

    def stats(self, name: str) -> DataFrame:
        return statistics.column_statistics(self.spark.table(name))

    # stored distinct counts by group

    def materialize_gd(self, name: str, group: str, target: str) -> str:
        stored = f"gd_{name}_{group}_{target}"
        self.store.drop(stored, True)
        df = self.spark.table(name).groupBy(group).agg(F.countDistinct(target).alias("distinct_count"), F.count("*").alias("row_count"))
        self.store.create(stored, df.dtypes)
        self.store.append(stored, df)
        self.refresh()
        return stored

    def gd_trim(self, name: str, group: str, target: str, exclude_values: list) -> int:
        removed = 0
        for v in exclude_values:
            literal = "NULL" if v is None else sqlfront.quote(v) if isinstance(v, str) else repr(v)
            removed += self.store.delete(f"gd_{name}_{group}_{target}", f"`{group}` <=> {literal}")
        self.refresh()
        return removed

    def gd_inspect(self, name: str, group: str, target: str) -> DataFrame:
        return self.spark.table(f"gd_{name}_{group}_{target}")
