"""The named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import sqlfront
from ..sources.tables import TABLES
from . import corpus, tables  # noqa: F401  (adds its queries to FRAMES)
from .frames import FRAMES


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query in the engine's dialect over the tables of a folder; leaves no view or setting in the session."""
    return sqlfront.run(spark, sql, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


def _of(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _of(sql) for name, sql in corpus.SQL.items()} | {name: f for name, (f, _) in FRAMES.items()}
ORACLE_SQL: dict[str, str] = {**corpus.SQL, **{name: sql for name, (_, sql) in FRAMES.items()}}
