"""Streams of events. The reference has none; these are extensions for tables that grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, of the schema that it has now; timestamps as Spark's watermarks need them."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def maintained_counts(events: DataFrame, keys: list[str], table: str, read: Callable[[], DataFrame | None], replace: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Keeps counts by key up to date batch by batch: each batch is counted by itself and merged with what is stored.
    A batch that comes again after a failure must not count twice, so the stored rows carry the batch's number."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*keys).agg(F.count("*").alias("n"))
        old = read()
        if old is not None:
            done = old.agg(F.max("batch")).first()[0]
            if done is not None and done >= number:
                return
            new = old.select(*keys, "n").unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))
        replace(new.withColumn("batch", F.lit(number).cast("long")))

    return events.writeStream.queryName(table).outputMode("append").foreachBatch(merge)
