"""Connected components of an edge table, without collecting it: local forests, then alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_hot, materialize


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Joins the sets of a[i] and b[i] in place; labels[x] is the smallest member of x's set. True if any joined."""
    any_joined = False
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        any_joined = True
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
    return any_joined


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges between any numbers, (node, smallest node of its set) of the nodes that aren't the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = np.arange(len(nodes))
    merge_labels(labels, at[: len(a)], at[len(a) :])
    below = labels != np.arange(len(nodes))
    return nodes[below], nodes[labels[below]]


def _local(batches, limit: int = 500_000):
    held, rows = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        rows += b.num_rows
        if rows >= limit:
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) >= limit // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["u", "v"])
            rows = sum(len(x[0]) for x in held)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate(x) for x in zip(*held)))], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Rows (u, v), u > v. Large: each node's larger neighbours go to the smallest of it and its neighbours.
    Small: each node and its smaller neighbours go to the smallest of these."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree"))
        out = join_hot(both, least, "u", "degree").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        near = join_hot(edges, least, "u", "degree")
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns, any direction, repeats and loops allowed. Returns node, component (the smallest
    node reachable) of the nodes that aren't the smallest of their component themselves."""
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    now = materialize(arrow_map(pairs, _local, "u long, v long").distinct(), "cc")
    state = None
    while True:
        now = materialize(_star(_star(now, True), False), "cc")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = new
