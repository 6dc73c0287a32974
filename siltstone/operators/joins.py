"""Joins on DataFrames. Which side is broadcast is Spark's choice, from sizes that it knows or measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_all(first: DataFrame, *steps: tuple[DataFrame, Column | str | list[str]]) -> DataFrame:
    """A chain or star of inner joins; Catalyst orders them by cost where it has statistics."""
    return reduce(lambda df, step: df.join(step[0], step[1]), steps, first)


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """IN and EXISTS."""
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """NOT EXISTS: a NULL key has no partner, so its row stays."""
    return df.join(other, on, "left_anti")


def not_in(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """NOT IN: no row if any of the others is NULL; a NULL stays only if there are no others."""
    values = others.select(F.col(other).alias("__v"))
    state = values.agg(F.count("*").alias("__n"), F.count("__v").alias("__known"))
    left = df.crossJoin(F.broadcast(state)).filter((F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(column).isNotNull()))
    return left.join(values, left[column] == F.col("__v"), "left_anti").select(*df.columns)


def counting_left_join(parent: DataFrame, child: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Each parent's key with the number of its children, 0 included. Children are counted before the join."""
    counts = child.groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias(name))
    joined = parent.join(counts, parent[key] == F.col("__k"), "left").drop("__k")
    return joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def aggregate_then_join(fact: DataFrame, fact_key: str, sums: dict[str, Column], dimension: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Sums of a fact by columns of its dimension: summed by key first, so the join shuffles a row per key."""
    first = fact.groupBy(F.col(fact_key).alias("__k")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return first.join(dimension, F.col("__k") == dimension[key]).groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums])


def reduce_by(fact: DataFrame, *filters: tuple[DataFrame, str, str]) -> DataFrame:
    """Semi-join reduction: of the fact's rows, those whose keys occur in every filtered dimension; only the rest of
    a star join sees them."""
    for dimension, fact_key, key in filters:
        keys = dimension.select(F.col(key).alias("__k")).distinct()
        fact = fact.join(keys, fact[fact_key] == F.col("__k"), "left_semi")
    return fact


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> None:
    if not parent.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    keys = parent.select(F.col(key).alias("__k"))
    if not child.filter(F.col(column).isNotNull()).join(keys, child[column] == F.col("__k"), "left_anti").isEmpty():
        raise ValueError(f"{column} holds values that {key} lacks")


def range_join(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points in [low, high] of spans, by an equi-join on buckets of the given width instead of all pairs."""
    bucketed = points.withColumn("__b", F.floor(F.col(at) / width))
    spread = spans.withColumn("__sb", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    joined = bucketed.join(spread, F.col("__b") == F.col("__sb")).filter(F.col(at).between(F.col(low), F.col(high)))
    return joined.drop("__b", "__sb")
