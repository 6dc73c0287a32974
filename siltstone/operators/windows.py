"""Window frames by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import folder
from .relational import nulls_last


def ordered(keys: list[str], *columns: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*[nulls_last(c) for c in columns])


def running(value: Column, keys: list[str], *columns: str) -> Column:
    """From the start to the current row and its peers."""
    return value.over(ordered(keys, *columns).rangeBetween(Window.unboundedPreceding, Window.currentRow))


def running_rows(value: Column, keys: list[str], *columns: str) -> Column:
    """From the start to the current row."""
    return value.over(ordered(keys, *columns).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def moving(value: Column, before: int, keys: list[str], *columns: str) -> Column:
    """Over `before` rows and the current one."""
    return value.over(ordered(keys, *columns).rowsBetween(-before, 0))


def total(value: Column, keys: list[str]) -> Column:
    return value.over(Window.partitionBy(*keys))


def share(column: str, keys: list[str]) -> Column:
    """A row's part of its group's sum; NULL where that is 0."""
    return F.try_divide(F.col(column), total(F.sum(column), keys))


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Rows numbered from 1 in an order over all of them, and how many there are. Rows are sorted in ranges, written so
    that the ranges stay as they are, and counted by range; only the counts reach the driver."""
    spark = df.sparkSession
    path = folder(spark, "numbered")
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place in it below
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, place).write.parquet(path)
    rows = spark.read.parquet(path)
    part, at = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for k, n in counts:
        before.append((k, total))
        total += n
    if not before:
        return rows, 0
    offsets = spark.createDataFrame(before, "__part long, __before long")
    out = rows.join(F.broadcast(offsets), part == F.col("__part"))
    return out.withColumn(name, at + F.col("__before") + 1).drop("__part", "__before"), total


def with_sessions(df: DataFrame, time: str, gap_seconds: float, keys: list[str], *ties: str) -> DataFrame:
    """Adds `session`, the number of a row's session in its group, from 0: a new one begins after a gap."""
    w = ordered(keys, time, *ties)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    late = F.coalesce(micros - F.lag(micros).over(w) > F.lit(int(gap_seconds * 1e6)), F.lit(False))
    flagged = df.withColumn("__late", late.cast("bigint"))
    total_so_far = F.sum("__late").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.withColumn("session", total_so_far).drop("__late")
