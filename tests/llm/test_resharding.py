import itertools
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import resharding


def test_flow_moves_the_fewest_bytes():
    """Against all integer flows of small problems."""
    for supply, capacity in (([5, 1], [2, 2, 2]), ([0, 4], [1, 3]), ([3, 3], [6])):
        m, n = len(supply), len(capacity)
        cost = [[int(i != j) for j in range(n)] for i in range(m)]
        got = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(got.get((i, j), 0) for j in range(n)) for i in range(m)] == supply
        assert all(sum(got.get((i, j), 0) for i in range(m)) <= capacity[j] for j in range(n))
        best = min(
            sum(x * cost[k // n][k % n] for k, x in enumerate(f))
            for f in itertools.product(*[range(supply[k // n] + 1) for k in range(m * n)])
            if all(sum(f[i * n : (i + 1) * n]) == supply[i] for i in range(m)) and all(sum(f[j::n]) <= capacity[j] for j in range(n))
        )
        assert sum(x * cost[i][j] for (i, j), x in got.items()) == best
    general = resharding.min_cost_flow([4, 4], [4, 4], [[9, 1], [1, 9]])
    assert general == {(0, 1): 4, (1, 0): 4}
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4], [[1]])


def test_odd_rows(odd, texts):
    placed, made = resharding.reshard(odd, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3, 4, blocks=8)
    rows = placed.collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert made.moved_bytes == sum(r["size"] for r in rows if r.shard != r.old_shard)


def test_empty_table(none):
    placed, made = resharding.reshard(none, F.lit(0), 1, 4)
    assert placed.count() == 0 and made.affected() == []


def test_sizes_are_near_equal_and_little_moves(spark):
    rows = [(i, "x" * (50 + i % 37)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed, made = resharding.reshard(df, F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.pmod("doc_id", F.lit(8))), 8, 10)
    sizes = [r["size"] for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect()]
    total = sum(sizes)
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.02 * total / 10
    held = placed.groupBy("old_shard").agg(F.sum("size").alias("size")).collect()
    least = sum(max(0, r["size"] - total / 10) for r in held)
    assert 0.98 * least <= made.moved_bytes <= 1.02 * least + 100  # whole blocks move


def test_rewrite_leaves_other_shards(spark, tmp_path):
    rows = [(i, f"text {i:03d}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = F.when(F.col("doc_id") < 60, 0).when(F.col("doc_id") < 90, 1)
    path = f"{tmp_path}/shards"
    df.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    placed, made = resharding.reshard(df, old, 2, 3)
    assert resharding.rewrite(df, old, made, path) == [0, 2]
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 30, 1: 30, 2: 30}


def test_rewrite_of_odd_rows(odd, texts, tmp_path):
    """Null and repeated identifiers are written once a row, in the slots of the placement; old shard 3 ends up empty
    and its folder goes."""
    old = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    path = f"{tmp_path}/shards"
    odd.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    placed, made = resharding.reshard(odd, old, 4, 3, blocks=8)
    changed = resharding.rewrite(odd, old, made, path, blocks=8)
    assert 3 in changed and not (tmp_path / "shards" / "shard=3").exists()
    back = odd.sparkSession.read.parquet(path).filter(F.col("shard").isin(changed))
    got = sorted(((r.doc_id, r.text, r.lang) for r in back.collect()), key=str)
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((i, crc(t)) for i, t, _ in got), key=str) == sorted(((r.doc_id, r.text_crc32) for r in placed.collect() if r.shard in changed), key=str)
    assert sorted(((r.doc_id, crc(r.text), r.shard, r.slot) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in placed.collect() if r.shard in changed), key=str)


def test_plan_bounds():
    sizes = pd.DataFrame({"old": [0, 0, 1], "block": [0, 1, 0], "n": [1, 2, 3], "bytes": [10, 20, 30]})
    made = resharding.plan(sizes, 2, [30, 30])
    assert made.moved_bytes == 0 and made.blocks["shard"].tolist() == [0, 0, 1] and made.blocks["base"].tolist() == [0, 1, 0]
