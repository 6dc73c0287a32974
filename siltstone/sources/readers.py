"""Reading and writing files, with the casts that a load declares."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Casts of integers, by name.
CASTS = {
    "date_days": lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int")),
    "timestamp_s": lambda c: F.timestamp_seconds(c).cast("timestamp_ntz"),
    "timestamp_ms": lambda c: F.timestamp_millis(c).cast("timestamp_ntz"),
    "timestamp_us": lambda c: F.timestamp_micros(c).cast("timestamp_ntz"),
}


def read(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV, by the path's ending if no format is given."""
    format = format or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "parquet"
    if format in ("tsv", "csv"):
        reader = spark.read.option("header", True).option("sep", "\t" if format == "tsv" else ",")
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if format in ("json", "jsonl", "ndjson"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    return (spark.read.schema(schema) if schema else spark.read).format(format).load(path)


def read_many(spark: SparkSession, paths: list[str], format: str = "parquet") -> DataFrame:
    """Files of one schema as one table."""
    return spark.read.format(format).load(paths)


def cast_columns(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """casts: column -> a name in CASTS, or an SQL type."""
    made: dict[str, Column] = {c: CASTS[k](F.col(c)) if k in CASTS else F.col(c).cast(k) for c, k in casts.items()}
    return df.withColumns(made)


def lay_out(df: DataFrame, cluster_by: list[str] | None = None, hash_by: list[str] | None = None, files: int | None = None) -> DataFrame:
    """Rows in files by range of the cluster key, sorted, so that row groups of other ranges are skipped at reading;
    or by hash, for later joins."""
    if cluster_by:
        ranged = df.repartitionByRange(files, *cluster_by) if files else df.repartitionByRange(*cluster_by)
        return ranged.sortWithinPartitions(*cluster_by)
    if hash_by:
        return df.repartition(files, *hash_by) if files else df.repartition(*hash_by)
    return df.coalesce(files) if files else df


def prepared(df: DataFrame, casts: dict[str, str] | None = None, cluster_by: list[str] | None = None, hash_by: list[str] | None = None, row_lengths: list[str] | None = None) -> DataFrame:
    df = cast_columns(df, casts or {})
    for c in row_lengths or []:
        df = df.withColumn(f"{c}_length", F.length(c).cast("bigint"))
    return lay_out(df, cluster_by, hash_by)


def load(spark: SparkSession, source: str, target: str, casts: dict[str, str] | None = None, cluster_by: list[str] | None = None, hash_by: list[str] | None = None, row_lengths: list[str] | None = None, format: str | None = None) -> DataFrame:
    """Writes a source as Parquet laid out for reading. row_lengths: text columns whose length becomes a column."""
    prepared(read(spark, source, format), casts, cluster_by, hash_by, row_lengths).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often: nothing is left either way."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Result sinks: csv and tsv with a header, json lines, or any of Spark's formats."""
    writer = df.write.mode(mode)
    if format in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if format == "tsv" else ",").csv(path)
    else:
        writer.format(format).save(path)
