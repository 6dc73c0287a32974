"""Filters, top-k, set operations and grouping on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nulls_last(column: str) -> Column:
    """A column name, with a leading minus for descending; NULLs last either way."""
    return F.col(column[1:]).desc_nulls_last() if column.startswith("-") else F.col(column).asc_nulls_last()


def order_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[nulls_last(c) for c in columns])


def top_k(df: DataFrame, k: int, *columns: str, offset: int = 0) -> DataFrame:
    """Plans as TakeOrderedAndProject: each task keeps k rows, so nothing is sorted as a whole."""
    ordered = order_by(df, *columns)
    return (ordered.offset(offset) if offset else ordered).limit(k)


def top_k_by_group(df: DataFrame, k: int, keys: list[str], *columns: str) -> DataFrame:
    """The first k rows of each group. The filter on row_number() plans as WindowGroupLimit, which drops rows before
    the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[nulls_last(c) for c in columns])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def distinct_on(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return top_k_by_group(df, 1, keys, *columns)


def qualify(df: DataFrame, value: Column, keep) -> DataFrame:
    """Rows for which keep(value) is true; value is a window expression."""
    return df.withColumn("__q", value).filter(keep(F.col("__q"))).drop("__q")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """aggregates: name -> (count | sum | min | max | avg, column). The rows are read and shuffled once, at the finest
    level; the coarser levels are made from its groups, so nothing is expanded by the number of sets."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    base, again, final = [], [], []
    for name, (kind, column) in aggregates.items():
        c = F.lit(1) if column == "*" else F.col(column)
        if kind == "avg":
            base += [F.sum(c.cast("double")).alias(f"{name}__s"), F.count(c).alias(f"{name}__n")]
            again += [F.sum(f"{name}__s").alias(f"{name}__s"), F.sum(f"{name}__n").alias(f"{name}__n")]
            final.append(F.try_divide(f"{name}__s", f"{name}__n").alias(name))
        else:
            first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[kind]
            base.append(first(c).alias(name))
            again.append((F.sum if kind == "count" else first)(name).alias(name))
            final.append(F.coalesce(F.col(name), F.lit(0)).alias(name) if kind == "count" else F.col(name))
    finest = df.groupBy(*keys).agg(*base)
    parts = []
    for s in sets:
        absent = [F.lit(None).cast(dict(df.dtypes)[k]).alias(k) for k in keys if k not in s]
        level = finest if set(s) == set(keys) else finest.groupBy(*s).agg(*again)
        parts.append(level.select(*[F.col(k) for k in s], *absent, *final).select(*keys, *aggregates))
    return union_all(*parts)


def compare_all(df: DataFrame, column: str, op: str, others: DataFrame, other: str, some: bool = False) -> DataFrame:
    """Rows for which `column op ALL (others)` is true (ANY with some): against one row of bounds, not each value."""
    edge = (F.max if (op in (">", ">=")) != some else F.min)(other)
    bounds = others.agg(edge.alias("__w"), F.count("*").alias("__n"), F.count(other).alias("__known"))
    test = F.expr(f"`{column}` {op} __w")
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    if some:
        kept = joined.filter((F.col("__n") > 0) & test)
    else:
        kept = joined.filter((F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & test))
    return kept.select(*df.columns)
