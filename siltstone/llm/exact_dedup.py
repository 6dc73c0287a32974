"""Exact dedup by a log-structured merge index of digests.

Each task puts the digests of its rows in a memtable; a full memtable is flushed as a run sorted by digest, with
a Bloom filter. New digests probe the filters of older runs first, and those found there are merged in place.
When there are too many runs, they are compacted into one, which keeps the smallest identifier of a digest and
the sum of its counts. What the tasks hold at their end, one entry per digest and task, is shuffled by digest and
compacted once more, so a digest that a third of all rows share is one row per task.

Hits, digests of more than one row, get byte verification: the texts of their rows are compared with the text of
the row that stays, the rows of large groups dealt out by salt. Rows that differ in spite of equal digests are
grouped by their whole texts instead.

Texts: null counts as empty, and equal texts are those identical after no change. `keep` is "min" or "max": which
identifier stays (for "max" the index holds complements, -1 - identifier). Rows that repeat an identifier and its text
count one by one and are all marked as that row is. A null identifier never stays beside another; a group of null
identifiers only has a null keep_id and stays. An empty table gives an empty one. Other columns of the input are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_hot, materialize, text_of

MEMTABLE, FAN_IN = 65_536, 6
#: Bits of the filter over all hits; beyond about a tenth of it as many hits it only saves less.
FILTER_BITS = 1 << 24
#: Rows of a group that are verified by one key of the shuffle.
SALT_ROWS = 500
_NONE = np.iinfo(np.int64).max


class Run:
    """Digests sorted, with the smallest identifier and the count of each, and a Bloom filter."""

    def __init__(self, digest: np.ndarray, first: np.ndarray, count: np.ndarray):
        order = np.lexsort((first, digest))
        digest, first, count = digest[order], first[order], count[order]
        lead = np.ones(len(digest), bool)
        lead[1:] = digest[1:] != digest[:-1]
        at = np.flatnonzero(lead)
        self.digest, self.first = digest[at], first[at]
        self.count = np.add.reduceat(count, at) if len(at) else count
        self.bits = max(64, 1 << int(10 * len(at)).bit_length())
        self.filter = np.zeros(self.bits // 8, np.uint8)
        for p in self._places(self.digest):
            np.bitwise_or.at(self.filter, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def _places(self, digest: np.ndarray) -> list[np.ndarray]:
        words = np.frombuffer(digest.astype("S32").tobytes(), ">u8").reshape(-1, 4).astype(np.uint64)
        return [(words[:, k] % np.uint64(self.bits)).astype(np.int64) for k in range(3)]

    def find(self, digest: np.ndarray) -> np.ndarray:
        """The place of each digest, or -1."""
        maybe = np.ones(len(digest), bool)
        for p in self._places(digest):
            maybe &= (self.filter[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        out = np.full(len(digest), -1, np.int64)
        if maybe.any() and len(self.digest):
            at = np.minimum(np.searchsorted(self.digest, digest[maybe]), len(self.digest) - 1)
            out[maybe] = np.where(self.digest[at] == digest[maybe], at, -1)
        return out


class MergeIndex:
    def __init__(self, memtable: int = MEMTABLE, fan_in: int = FAN_IN):
        self.most, self.fan_in = memtable, fan_in
        self.runs: list[Run] = []
        self.mem: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def put(self, digest: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        for run in self.runs:
            at = run.find(digest)
            if (hit := at >= 0).any():
                np.minimum.at(run.first, at[hit], first[hit])
                np.add.at(run.count, at[hit], count[hit])
                digest, first, count = digest[~hit], first[~hit], count[~hit]
        if len(digest):
            self.mem.append((digest, first, count))
            self.held += len(digest)
            if self.held >= self.most:
                self.flush()

    def flush(self) -> None:
        if self.mem:
            self.runs.append(Run(*(np.concatenate(x) for x in zip(*self.mem))))
            self.mem, self.held = [], 0
            if len(self.runs) >= self.fan_in:
                self.compact()

    def compact(self) -> None:
        if len(self.runs) > 1:
            self.runs = [Run(*(np.concatenate([getattr(r, k) for r in self.runs]) for k in ("digest", "first", "count")))]

    def all(self) -> Run | None:
        self.flush()
        self.compact()
        return self.runs[0] if self.runs else None


def _raw(column: pa.Array, width: int) -> np.ndarray:
    """A column of binaries, all of one width, as numpy's fixed-width bytes, which sort as bytes do."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=f"S{width}")


def _index(batches, width: int, memtable: int, fan_in: int):
    index = MergeIndex(memtable, fan_in)
    for b in batches:
        if b.num_rows:
            index.put(_raw(b.column(0), width), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
    if run := index.all():
        for k in range(0, len(run.digest), 10_000):
            part = slice(k, k + 10_000)
            raw = [x.ljust(width, b"\0") for x in run.digest[part].tolist()]  # numpy drops zeros at the end
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(run.first[part]), pa.array(run.count[part])], names=["digest", "first", "n"])


def _hit_filter(hits: DataFrame, bits: int):
    """A Bloom filter of fixed size over the hits, built in parts that are joined word by word."""

    def part(batches):
        own = np.zeros(bits // 8, np.uint8)
        seen = False
        for b in batches:
            for p in _filter_places(b.column(0), bits):
                seen = True
                np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))
        if seen:
            step = len(own) // 64
            keep = [k for k in range(64) if own[k * step : (k + 1) * step].any()]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([own[k * step : (k + 1) * step].tobytes() for k in keep], pa.binary())], names=["k", "bits"])

    def join(key, table):
        own = np.zeros(bits // 8 // 64, np.uint8)
        for x in table.column(1).to_pylist():
            own |= np.frombuffer(x, np.uint8)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

    parts = arrow_map(hits.select("digest"), part, "k int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for k, x in parts.groupBy("k").applyInArrow(join, "k int, bits binary").collect():  # 64 rows, 2 MB in all
        whole[k * len(x) : (k + 1) * len(x)] = np.frombuffer(x, np.uint8)
    return whole


def _filter_places(column: pa.Array, bits: int) -> list[np.ndarray]:
    rows = column.to_pylist()
    if not rows:
        return []
    words = np.frombuffer(b"".join(x.ljust(16, b"\0")[:16] for x in rows), ">u8").reshape(-1, 2).astype(np.uint64)
    with np.errstate(over="ignore"):
        return [((words[:, 0] + np.uint64(k) * (words[:, 1] | np.uint64(1))) % np.uint64(bits)).astype(np.int64) for k in range(4)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest_bytes: int = 32, memtable: int = MEMTABLE, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size long, kept boolean, digest binary (the SHA-256, or its first
    digest_bytes). The index and the verification run when this is called."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    turned = (lambda c: c) if keep == "min" else F.bitwise_not  # its own inverse, without overflow
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)).substr(1, digest_bytes))
    keyed = rows.select("doc_id", "digest")
    # the smallest of what the index holds is the identifier that stays
    entries = keyed.select("digest", F.coalesce(turned(F.col("doc_id")), F.lit(_NONE)).alias("first"), F.lit(1).cast("long").alias("n"))
    schema = "digest binary, first long, n long"
    runs = arrow_map(entries, lambda it: _index(it, digest_bytes, memtable, fan_in), schema)
    hits = runs.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
    # _NONE is also what the last of all identifiers is held as: if rows have it, their digests say which is meant
    last = keyed.filter(F.col("doc_id") == F.lit(_NONE if keep == "min" else -1 - _NONE)).select("digest")
    nobody = F.col("first") == _NONE
    if not last.isEmpty():
        hits = hits.join(last.distinct().withColumn("__last", F.lit(True)), "digest", "left")
        nobody = nobody & F.col("__last").isNull()
    hits = materialize(hits.select("digest", F.when(~nobody, turned(F.col("first"))).alias("keep_id"), F.col("n").alias("group_size")), "dedup-hits")
    placed = join_hot(keyed, hits, "digest", "group_size")
    single = F.col("group_size").isNull()
    placed = placed.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(single, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"), "digest")
    placed = materialize(placed, "dedup-placed")
    differing = _differing(rows, hits)
    if differing.isEmpty():
        return _marked(placed)
    # Equal digests of different texts: their rows are grouped by their texts, the hottest joined by broadcast.
    bad = materialize(differing.select("digest").distinct(), "dedup-bad")
    again = rows.join(bad, "digest", "left_semi")
    exact = again.groupBy("digest", "text").agg((F.max if keep == "max" else F.min)("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    exact = again.join(exact, ["digest", "text"]).select("doc_id", "keep_id", "group_size", "digest")
    return _marked(placed.join(bad, "digest", "left_anti").select(*exact.columns).unionByName(exact))


def _differing(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of groups whose text isn't the text of the row that stays. Only rows that pass the filter over all
    hits have their texts read into the shuffle."""
    bits = FILTER_BITS
    wanted = hits.sparkSession.sparkContext.broadcast(_hit_filter(hits, bits))

    def passing(batches):
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for p in _filter_places(b.column(2), bits):
                ok &= (wanted.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            if ok.any():
                yield b.filter(pa.array(ok))

    # rows that repeat an identifier and its text are told apart by where they were read
    salt = F.xxhash64("doc_id", F.spark_partition_id())
    texts = arrow_map(rows.select("doc_id", "text", "digest", salt.alias("salt")), passing, "doc_id long, text string, digest binary, salt long")
    with_text = join_hot(texts, hits, "digest", "group_size").filter("group_size is not null")
    salts = F.ceil(F.col("group_size") / SALT_ROWS)
    stays = with_text.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    stays = stays.select(F.col("digest").alias("s_digest"), F.col("text").alias("s_text"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("s_slot"))
    others = with_text.select("doc_id", "digest", "text", F.pmod("salt", salts).cast("long").alias("slot"))
    pairs = others.join(stays, (F.col("digest") == F.col("s_digest")) & (F.col("slot") == F.col("s_slot")), "left")
    return pairs.filter(~F.col("text").eqNullSafe(F.col("s_text"))).select("doc_id", "digest")


def _marked(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
