"""Resharding by minimum-cost flow.

From the bytes that each old shard holds and the capacities of the new ones, a minimum-cost flow says how many
bytes go from which old shard to which new one so that the fewest bytes move (what stays costs nothing). Shards are
moved by blocks, hash ranges of identifiers and texts within an old shard. Only the sizes of blocks reach the driver: old
shards times blocks per shard, whatever the input; a shard that holds a third of all rows is cut like any other.
Blocks fill the flow's quotas, largest first, and each row follows its block. Its slot is its rank in the block
after the rows of the blocks before it. Last, the files of the shards whose contents change are rewritten.

Size: UTF-8 bytes of the text (null: none) plus `overhead`. Law: bytes; the sizes of new shards are near equal.
Equal texts are no group here and may part. Rows that repeat an identifier with its text follow one block and take a
slot each; a null identifier is hashed like any other. An empty table gives an empty one. Other columns are left out of
the placement; rewrite() keeps them, but for columns named shard and slot.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Of an old shard.
BLOCKS = 2048
#: Of rows that one file of a rewritten shard holds, about.
FILE_BYTES = 128 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """(old, new) -> bytes, all supply placed at the least total cost; successive shortest paths."""
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the old ones")
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    graph: list[list[list]] = [[] for _ in range(m + n + 2)]  # [to, left, cost, place of the reverse edge]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(n):
            edge(i, m + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(m + j, sink, c, 0)
    while True:
        far, queue, came = [None] * len(graph), deque([source]), {}
        far[source] = 0
        waiting = {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (far[b] is None or far[a] + price < far[b]):
                    far[b], came[b] = far[a] + price, (a, k)
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if far[sink] is None:
            break
        path, b = [], sink
        while b != source:
            path.append(came[b])
            b = came[b][0]
        pushed = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            b, back = graph[a][k][0], graph[a][k][3]
            graph[a][k][1] -= pushed
            graph[b][back][1] += pushed
    return {(i, e[0] - m): graph[e[0]][e[3]][1] for i in range(m) for e in graph[i] if m <= e[0] < m + n and graph[e[0]][e[3]][1]}


@dataclass
class Plan:
    flow: dict[tuple[int, int], int]
    #: old, block, shard, base (slot of the block's first row), before (bytes of the shard's blocks before it)
    blocks: pd.DataFrame
    moved_bytes: int

    def affected(self) -> list[int]:
        """New shards whose files change: those that gain or lose bytes."""
        return sorted({j for i, j in self.flow if i != j} | {i for i, j in self.flow if i != j})


def plan(sizes: pd.DataFrame, old_shards: int, capacity: list[int]) -> Plan:
    """sizes: old, block, n, bytes."""
    supply = [0] * old_shards
    for old, held in sizes.groupby("old")["bytes"].sum().items():
        supply[int(old)] = int(held)
    cost = [[int(i != j) for j in range(len(capacity))] for i in range(old_shards)]
    flow = min_cost_flow(supply, capacity, cost)
    over = [0] * len(capacity)  # assigned beyond the flow by the old shards so far
    rows, moved = [], 0
    for old, part in sizes.sort_values(["old", "bytes", "block"], ascending=[True, False, True]).groupby("old", sort=True):
        old = int(old)
        left = {j: b - over[j] for (i, j), b in flow.items() if i == old} or {old % len(capacity): 0}
        for block, n, size in zip(part["block"].tolist(), part["n"].tolist(), part["bytes"].tolist()):
            # the target that lacks most; of equals, the one where nothing moves
            to = max(left, key=lambda j: (left[j], j == old, -j))
            left[to] -= size
            moved += size if to != old else 0
            rows.append((old, block, to, n, size))
        for (i, j), _ in flow.items():
            if i == old:
                over[j] = -left[j]
    blocks = pd.DataFrame(rows, columns=["old", "block", "shard", "n", "bytes"]).astype("int64").sort_values(["shard", "old", "block"])
    blocks["base"] = blocks.groupby("shard")["n"].cumsum() - blocks["n"]
    blocks["before"] = blocks.groupby("shard")["bytes"].cumsum() - blocks["bytes"]
    return Plan(flow, blocks[["old", "block", "shard", "base", "before"]].astype("int64"), int(moved))


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, blocks: int = BLOCKS) -> tuple[DataFrame, Plan]:
    """Rows doc_id, size, text_crc32, old_shard, shard, slot; and the plan. Sizes are read when this is called."""
    meta = docs.select(*_keys(old_shard, id_col, text_col, overhead, blocks))
    meta = materialize(meta, "reshard-meta")
    sizes = meta.groupBy("old", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toPandas()
    total = int(sizes["bytes"].sum())
    capacity = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    made = plan(sizes, old_shards, capacity)
    placed = meta.join(F.broadcast(_targets(meta, made)), (F.col("old") == F.col("to_old")) & (F.col("block") == F.col("to_block")))
    rank = F.row_number().over(Window.partitionBy("old", "block").orderBy("doc_id", "text_crc32", "size"))
    slot = (F.col("base") + rank - 1).cast("long").alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.col("old").alias("old_shard"), "shard", slot), made


def _keys(old_shard: Column, id_col: str, text_col: str, overhead: int, blocks: int) -> list[Column]:
    """What places a row, from its own columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return [
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        crc.alias("text_crc32"),
        old_shard.cast("int").alias("old"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(blocks)).cast("int").alias("block"),
    ]


def _targets(df: DataFrame, made: Plan) -> DataFrame:
    schema = "to_old long, to_block long, shard long, base long, before long"
    rows = df.sparkSession.createDataFrame(made.blocks, schema) if len(made.blocks) else df.sparkSession.createDataFrame([], schema)
    return rows.select(F.col("to_old").cast("int"), F.col("to_block").cast("int"), F.col("shard").cast("int"), "base", "before")


def rewrite(docs: DataFrame, old_shard: Column, made: Plan, path: str, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, blocks: int = BLOCKS, file_bytes: int = FILE_BYTES) -> list[int]:
    """Writes the shards whose contents change to path/shard=N, in files by slot, and leaves the other folders of the
    dataset as they are; folders of changed shards that hold no row any more go. A row is placed from its own columns,
    as reshard() does with the same arguments, so rows that repeat an identifier or have none are written once each.
    Whole blocks make a file, so rows are shuffled once: what deals them to files also brings a block together for its
    slots. The dataset's rows must not be read from `path` itself. Returns the shards that change."""
    changed = made.affected()
    named = [f"__k_{c}" for c in ("doc_id", "size", "text_crc32", "old", "block")]
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed = docs.select(*kept, *[c.alias(n) for c, n in zip(_keys(old_shard, id_col, text_col, overhead, blocks), named)])
    targets = _targets(docs, made).filter(F.col("shard").isin(changed))
    placed = keyed.join(F.broadcast(targets), (F.col("__k_old") == F.col("to_old")) & (F.col("__k_block") == F.col("to_block")))
    dealt = placed.withColumn("__file", F.floor(F.col("before") / file_bytes)).repartition("shard", "__file")
    # sorted by block as the slots are, so the files are in slot order
    rank = F.row_number().over(Window.partitionBy("shard", "__file", "__k_old", "__k_block").orderBy("__k_doc_id", "__k_text_crc32", "__k_size"))
    out = dealt.withColumn("slot", (F.col("base") + rank - 1).cast("long")).select(*kept, "shard", "slot")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    sc = docs.sparkSession.sparkContext
    for j in set(changed) - {int(j) for j in made.blocks["shard"]}:
        where = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={j}")
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    return changed
