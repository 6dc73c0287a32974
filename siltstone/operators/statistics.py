"""What can be said of a table: functional dependencies and column statistics."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holds(df: DataFrame, determinant: str, dependent: str) -> bool:
    """Whether each value of the determinant goes with one value of the dependent (NULL being one)."""
    key = F.coalesce(F.to_json(F.struct(dependent)), F.lit(""))
    seen = df.groupBy(determinant).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    return seen.filter("__lo <> __hi").isEmpty()


def discover_dependencies(df: DataFrame, sample: float = 0.01, seed: int = 1) -> list[tuple[str, str]]:
    """Pairs (determinant, dependent) that hold. A sample rules most out, in one pass; the rest are verified over all
    rows. Determinants that are unique, or columns with one value, say nothing and are left out."""
    part = df.sample(sample, seed) if sample < 1 else df
    counts = df.agg(F.count("*").alias("__n"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in df.columns]).first()
    telling = [c for c in df.columns if 1 < counts[c] < 0.9 * max(1, counts["__n"])]
    pairs = [(a, b) for a, b in permutations(telling, 2) if counts[a] >= 0.9 * counts[b]]
    if not pairs:
        return []
    left = []
    for a in {a for a, _ in pairs}:
        ends = [b for x, b in pairs if x == a]
        wide = part.groupBy(a).agg(*[F.countDistinct(b).alias(b) for b in ends]).agg(*[F.max(b).alias(b) for b in ends]).first()
        left += [(a, b) for b in ends if (wide[b] or 0) <= 1]
    return sorted((a, b) for a, b in left if holds(df, a, b))


def column_statistics(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row per column: type, rows, nulls, how many distinct values (about, if not exact), least and greatest value as
    text. One pass, without a shuffle of values if not exact."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    made = []
    for c in df.columns:
        made += [F.count(c), distinct(F.col(c)), F.min(c).cast("string"), F.max(c).cast("string")]
    wide = df.agg(F.count("*").alias("n"), *[m.alias(f"c{k}") for k, m in enumerate(made)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("rows"), (F.col("n") - F.col(f"c{4 * k}")).alias("nulls"), F.col(f"c{4 * k + 1}").alias("distinct"), F.col(f"c{4 * k + 2}").alias("least"), F.col(f"c{4 * k + 3}").alias("greatest"))
        for k, (c, t) in enumerate(df.dtypes)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
