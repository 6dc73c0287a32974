"""A session with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that timestamps without zone mean the same everywhere; adaptive plans, so that partitions are merged and
#: skewed joins split at run time. ANSI mode stays on: overflow and bad casts are errors, not wrong numbers.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text,parquet",
}


def session(app: str = "siltstone", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
