"""What the operators of this subpackage share: shipping, scratch tables, hot keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold the most rows are joined by broadcast: at most so many rows, whatever the input.
HOT_KEYS = 1000

_shipped: dict[str, str] = {}
_own_root: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="ship-")
    path = os.path.join(folder, f"{package}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(top, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and the
    driver and the executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_root[app] = tempfile.mkdtemp(prefix="siltstone-")
    return _own_root[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts the lineage, survives the loss of
    executors, and fixes rows whose order or sampling a second evaluation might change."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Removes the scratch tables written so far."""
    while _written:
        spark, path = _written.pop()
        sc = spark.sparkContext
        if sc._jsc is None:
            continue
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def tidy() -> None:
    """Gives what a finished task freed back to the system: a worker lives on and would hold it beside the next
    stage's workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which has no such call
            pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def text_of(column: str = "text"):
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """left LEFT JOIN right on `key` (unique in right, never null in either), where `weight` counts the rows of
    left that hold the key. The HOT_KEYS heaviest keys are joined by broadcast, a bound that doesn't grow with
    the data; any other key then holds at most 1/HOT_KEYS of the rows that the shuffle deals. Columns of right
    other than the key must not occur in left."""
    given = [c for c in right.columns if c != key]
    renamed = right.select(F.col(key).alias("__rk"), *given)
    hot = renamed.orderBy(F.col(weight).desc(), F.col("__rk")).limit(HOT_KEYS)
    hot = hot.select(F.col("__rk").alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in given])
    near = left.join(F.broadcast(hot), left[key] == F.col("__hk"), "left")
    # A row served above gets a key of its own that matches nothing, so it lands anywhere.
    kind = dict(left.dtypes)[key]
    if kind == "binary":
        free = F.concat(F.lit(b"\xff"), F.col(key), F.unhex(F.hex(F.monotonically_increasing_id())))
    elif kind == "string":
        free = F.concat(F.lit("\x00"), F.col(key), F.monotonically_increasing_id().cast("string"))
    else:
        free = None
    near = near.withColumn("__served", F.col("__hk").isNotNull())
    if free is not None:
        near = near.withColumn("__jk", F.when(F.col("__served"), free).otherwise(F.col(key)))
        cond = F.col("__jk") == F.col("__rk")
    else:
        # a second, salted part: 0 for rows still to be served, else spread wide and never equal to 0
        near = near.withColumn("__salt", F.when(F.col("__served"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
        renamed = renamed.withColumn("__zero", F.lit(0).cast("long"))
        cond = (F.col(key) == F.col("__rk")) & (F.col("__salt") == F.col("__zero"))
    out = near.join(renamed, cond, "left")
    picked = [F.when(F.col("__served"), F.col(f"__h_{c}")).otherwise(F.col(c)).alias(c) for c in given]
    return out.select(*left.columns, *picked)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def read_bytes(path: str) -> bytes:
    with io.open(path, "rb") as f:
        return f.read()


class Memo(dict):
    """What `make` gave for the keys asked for lately: most entries or fewer of this generation, as many of the
    one before. Only a cache: any key is made anew when asked for again."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def unknown(self, keys: Iterable) -> list:
        """Of the keys, those that neither generation has; the older one's come into this one."""
        fresh = list(filterfalse(self.__contains__, keys))
        if self.old:
            for key in filter(self.old.__contains__, fresh):
                self[key] = self.old[key]
            fresh = list(filterfalse(self.__contains__, fresh))
        return fresh

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


#: Encoders that a Python worker keeps from task to task, by what made them.
KEPT: dict = {}
