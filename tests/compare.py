"""Rows of Spark and DuckDB in one form."""

import datetime
import decimal
import math

import duckdb

from siltstone.sources.tables import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(df, relation):
    columns = list(relation.columns)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, relation.fetchall())


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


def assert_same_types(df, relation):
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == {c: "BIGINT" if k == "HUGEINT" else k for c, k in theirs.items()}
