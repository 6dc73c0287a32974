"""Aggregates beyond Spark's own."""

from __future__ import annotations

import functools
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder

#: Groups of which one row each is broadcast, and the parts that a group's rows are dealt to beyond that.
GROUPS, SALTS = 100_000, 16


def affine_sums(df: DataFrame, column: str, shifts: list[int], keys: list[str] | None = None) -> DataFrame:
    """SUM(column + k) for many k, from one sum and one count."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    base = grouped.agg(F.sum(column).alias("__s"), F.count(column).alias("__n"))
    made = [F.when(F.col("__n") > 0, F.col("__s") + F.lit(k) * F.col("__n")).cast("bigint").alias(f"s{k}") for k in shifts]
    return base.select(*(keys or []), *made)


def distinct_count_by_group(df: DataFrame, keys: list[str], target: str, more: list[Column] | None = None) -> DataFrame:
    """COUNT(DISTINCT target) and other aggregates by group. The distinct pairs come first, so a hot group's values
    are spread over the tasks by pair."""
    if not more:
        pairs = df.filter(F.col(target).isNotNull()).select(*keys, target).distinct()
        counted = pairs.groupBy(*keys).agg(F.count("*").alias("distinct_count"))
        groups = df.select(*keys).distinct()
        same = [groups[k].eqNullSafe(counted[k]) for k in keys]
        joined = groups.join(counted, same, "left")
        return joined.select(*[groups[k] for k in keys], F.coalesce(counted["distinct_count"], F.lit(0)).cast("bigint").alias("distinct_count"))
    return df.groupBy(*keys).agg(F.countDistinct(target).alias("distinct_count"), *more)


def salted(df: DataFrame, keys: list[str], count_as: str, salts: int, on: str) -> DataFrame:
    """Counts by key in two steps, the first by key and salt: for aggregates that have no partial form before."""
    salt = F.pmod(F.xxhash64(on), F.lit(salts))
    return df.groupBy(*keys, salt.alias("__salt")).agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.sum("__n").alias(count_as))


def merge_partials(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """AVG over several tables from each one's SUM and COUNT, as of hot and cold rows."""
    out = None
    for p in parts:
        one = p.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(F.sum("s").alias("total"), F.sum("n").alias("rows")).withColumn("mean", F.try_divide("total", "rows"))


def merge_distinct(parts: list[DataFrame], keys: list[str], target: str) -> DataFrame:
    """COUNT(DISTINCT target) and COUNT(*) over several tables: each one's counts by key and value are what merges."""
    out = None
    for p in parts:
        one = p.groupBy(*keys, target).agg(F.count("*").alias("__n"))
        out = one if out is None else out.unionByName(one)
    pairs = out.groupBy(*keys, target).agg(F.sum("__n").alias("__n"))
    return pairs.groupBy(*keys).agg(F.count(target).alias("distinct_count"), F.sum("__n").alias("row_count"))


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float, bool]]) -> DataFrame:
    """Exact quantiles by group: name -> (value, part, whether to go between two values, as QUANTILE_CONT does, or to
    take one of them). NULLs don't count; a group of nothing else has NULL. Equal values are counted before they are
    dealt in ranges of (key, value); from the counts by range follows the one range that a place lies in, and only there
    values are put in order. So neither a large group nor a frequent value is in one task."""
    spark = df.sparkSession
    out = df.select(*keys).distinct() if keys else spark.range(1).select(F.lit(1).alias("__one"))
    key = [f"__k{i}" for i in range(len(keys))]
    by_value: dict[str, list[str]] = {}
    for name, (value, _, _) in wanted.items():
        by_value.setdefault(value._jc.toString(), []).append(name)
    for names in by_value.values():
        value = wanted[names[0]][0]
        rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, key)], value.alias("__v")).filter(F.col("__v").isNotNull())
        counted = rows.groupBy(*key, "__v").agg(F.count("*").alias("__n"))
        dealt = counted.repartitionByRange(*[F.col(k).asc_nulls_last() for k in key], F.col("__v").asc())
        ranges = _written(dealt.withColumn("__part", F.spark_partition_id()))
        group = Window.partitionBy(*key)
        upto = F.sum("__in").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        spans = ranges.groupBy(*key, "__part").agg(F.sum("__n").alias("__in")).withColumns({"__all": F.sum("__in").over(group), "__before": upto - F.col("__in")})
        places = []  # from 0 in the group
        for i, name in enumerate(names):
            _, part, between = wanted[name]
            exact = F.lit(part) * (F.col("__all") - 1)
            nth = F.ceil(F.col("__all").cast("decimal(20,0)") * F.lit(Decimal(str(part)))).cast("bigint") - 1
            for side, at in enumerate([F.floor(exact), F.ceil(exact)] if between else [F.greatest(nth, F.lit(0))]):
                places.append(F.struct(F.lit(i).alias("name"), F.lit(side).alias("side"), at.cast("bigint").alias("at"), (exact - F.floor(exact)).alias("rest")))
        here = F.filter(F.array(*places), lambda p: (p["at"] >= F.col("__before")) & (p["at"] < F.col("__before") + F.col("__in")))
        asked = _written(spans.select(*[F.col(k).alias(f"{k}_") for k in key], F.col("__part").alias("__part_"), "__before", here.alias("__asked")).filter(F.size("__asked") > 0))
        near = ranges.join(asked, _same(ranges, key, asked, "{}_") & (ranges["__part"] == asked["__part_"]))
        order = Window.partitionBy(*key, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = near.withColumn("__upto", F.col("__before") + F.sum("__n").over(order))
        met = F.filter("__asked", lambda p: (p["at"] < F.col("__upto")) & (p["at"] >= F.col("__upto") - F.col("__n")))
        found = ranked.select(*key, "__v", F.explode(met).alias("p")).select(*key, "__v", "p.*")
        made = []
        for i, name in enumerate(names):
            side = lambda s: F.max(F.when((F.col("name") == i) & (F.col("side") == s), F.col("__v")))  # noqa: E731, B023
            rest = F.max(F.when(F.col("name") == i, F.col("rest")))
            low, high = side(0).cast("double"), side(1).cast("double")
            made.append((low + (high - low) * rest if wanted[name][2] else side(0)).alias(name))
        one = found.groupBy(*key).agg(*made)
        if keys:
            same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, key)])
            out = out.join(one, same, "left").drop(*key)
        else:
            out = out.crossJoin(F.broadcast(one))  # one row
    return out if keys else out.drop("__one")


def with_groups(df: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """The columns of a table of one row a group beside every row of it. Groups up to GROUPS are broadcast; beyond that
    each row goes to one of SALTS copies of its group, so that no task reads all rows of a large one."""
    groups = _written(groups.withColumnsRenamed({k: f"__key_{k}" for k in keys}))
    same = _same(df, keys, groups, "__key_{}")
    if groups.count() <= GROUPS:
        return df.join(F.broadcast(groups), same, "left")
    df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    groups = groups.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.join(groups, _same(df, keys, groups, "__key_{}") & (df["__salt"] == groups["__copy"]), "left").drop("__salt", "__copy")


def _written(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession, "aggregates")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: DataFrame, keys: list[str], b: DataFrame, named: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[named.format(k)]) for k in keys], F.lit(True))
