"""Folders for what a query writes on its way, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, removed at the end; under a folder of our own only where that is unset and
    the driver and the executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    path = f"{root}/siltstone-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return path


def clean() -> None:
    while _made:
        spark, path = _made.pop()
        sc = spark.sparkContext
        if sc._jsc is None:
            continue
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
