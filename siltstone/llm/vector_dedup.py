"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors are one from here on, with their multiplicity. A vector's sketch is the signs of its products with random
hyperplanes, `bits` of them for each of several tables; a table's key is its part of the sketch. So many tables are built
that a pair at the threshold meets in one of them with probability `recall`; keys get longer as the vectors get more,
by a rule. The sketch is all that is dealt to the tables, in two steps: in a table's bucket, a pair whose sketches
differ in no more bits than linked vectors do (five deviations above the mean at the threshold), and that meets in no
earlier table, marks both its vectors. Only marked ones are then sent to that bucket as vectors, once more with their
sketch. There cosines are computed in double precision block by block, and a pair counts in the first table in which it
meets, so links are counted once though no pair is ever returned: a bucket returns counts per vector and a forest of
its links. Components over all forests are found by distributed stars.

Buckets of more rows than BUCKET_ROWS, or more bytes of vectors than BUCKET_BYTES, are split into salted parts and each
pair of parts is searched, so every row of every bucket is compared. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing; so do vectors of different lengths. Rows that repeat an identifier count as
vectors each; a null identifier counts as a link of others and gets the component they reach. Other columns of the
input are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_hot, materialize
from .components import components, forest, merge_labels
from .mph import mix

#: Sketches, and bytes of vectors, that one bucket may hold before it is split.
BUCKET_ROWS, BUCKET_BYTES = 200_000, 64 << 20
BLOCK = 1024


def plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a key, tables), a rule of the number of vectors, the same at every size: about 2^7 unlike vectors
    meet in a bucket."""
    bits = min(62, max(8, math.ceil(math.log2(max(2, rows))) - 7))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def furthest(sketch: int, threshold: float) -> int:
    """Bits in which the sketches of linked vectors may differ: five deviations above the mean at the threshold."""
    apart = math.acos(threshold) / math.pi
    return math.ceil(sketch * apart + 5 * math.sqrt(sketch * apart * (1 - apart)))


def _matrix(raws: list[bytes], kind: str) -> np.ndarray:
    """Vectors in double precision, their greatest component 1."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


class Sketches:
    """Signs, table after table."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.planes: dict[int, np.ndarray] = {}

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes each."""
        if (size := x.shape[1]) not in self.planes:
            self.planes[size] = np.random.default_rng([self.seed, size]).standard_normal((size, self.bits * self.tables))
        return np.packbits(x @ self.planes[size] > 0, axis=1)

    def keys(self, sketch: np.ndarray) -> np.ndarray:
        """(rows, tables) numbers, equal where the keys are"""
        signs = np.unpackbits(sketch, axis=1, count=self.bits * self.tables).reshape(len(sketch), self.tables, self.bits)
        out = np.zeros((len(sketch), self.tables, 8), np.uint8)
        out[:, :, : -(-self.bits // 8)] = np.packbits(signs, axis=2)
        return out.view(np.uint64)[:, :, 0]


def _blocks(n: int):
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            yield a, b


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each row of x differs from each of y; rows of 64-bit words."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _first_met(keys: np.ndarray, table: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs meet in no table before this one."""
    return ~(keys[i, :table] == keys[j, :table]).any(axis=1)


def _words(sketch: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sketch), -(-sketch.shape[1] // 8) * 8), np.uint8)
    out[:, : sketch.shape[1]] = sketch
    return out.view(np.uint64)


def _by_bucket(batches, rows: int):
    """Tables of whole buckets, sorted by the first column, of so many rows or a bucket more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        last = b.column(0)[b.num_rows - 1].as_py()
        if sum(x.num_rows for x in held) >= rows and held[0].column(0)[0].as_py() != last:
            whole = pa.Table.from_batches(held)
            cut = int(np.searchsorted(whole.column(0).to_numpy(), last))
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _split(dealt: DataFrame, limit: int) -> DataFrame:
    """With `home`, the bucket, and `side`: buckets of more rows than the limit become buckets of each pair of their
    parts. side: 1 or 2 in a pair of parts, where only pairs across count; 0 in a part with itself."""
    whole = dealt.withColumn("home", F.col("bucket")).withColumn("side", F.lit(0))
    large = materialize(dealt.groupBy("bucket").count().filter(F.col("count") > limit), "vec-large")
    parts = F.ceil(F.col("count") / (limit / 2))
    split = whole.join(large, "bucket").withColumn("own", F.pmod(F.xxhash64("no"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    split = split.withColumn("side", side).withColumn("bucket", F.xxhash64("home", F.least("own", "other"), F.greatest("own", "other")))
    return whole.join(large, "bucket", "left_anti").unionByName(split.select(*whole.columns))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row: vec_id, n_links long, component_id long, kept boolean."""
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"  # as exact as the column
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    size = F.coalesce(F.size("v"), F.lit(0))
    bad = F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | F.col("v").isNull() | (size <= 0) | F.coalesce(F.forall("v", lambda x: x == 0), F.lit(False))
    rows = rows.withColumn("ok", ~bad).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0))))
    counted = vectors.count()
    bits, tables = plan(counted, threshold, recall)
    most = furthest(bits * tables, threshold)

    def prepare(batches):
        sketches = Sketches(bits, tables, seed)
        for b in batches:
            for k in range(0, b.num_rows, 5000):
                part = b.slice(k, 5000)
                raw = [None if x is None else np.array(x, kind).tobytes() for x in part.column(1).to_pylist()]
                sketch: list[bytes | None] = [None] * len(raw)
                lengths = np.array([len(x) if x else 0 for x in raw])
                for width in set(lengths.tolist()) - {0}:
                    at = np.flatnonzero(lengths == width)
                    for i, x in zip(at.tolist(), sketches.of(_matrix([raw[i] for i in at.tolist()], kind))):
                        sketch[i] = x.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary()), pa.array(sketch, pa.binary())], names=["vec_id", "raw", "sketch"])

    raw = arrow_map(rows.select("vec_id", "v"), prepare, "vec_id long, raw binary, sketch binary")
    raw = raw.withColumn("mark", F.unhex(F.sha2("raw", 256))).withColumn("row", F.monotonically_increasing_id())
    raw = materialize(raw, "vec-rows")
    # A distinct vector's number is that of a row that holds it.
    unique = raw.filter("raw is not null").groupBy("mark").agg(F.min("row").alias("no"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("sketch").alias("sketch"), F.min(F.length("raw")).alias("size"))
    unique = materialize(unique, "vec-distinct")

    def deal(batches):
        sketches = Sketches(bits, tables, seed)
        for b in batches:
            for k in range(0, b.num_rows, 5000):
                part = b.slice(k, 5000)
                sketch = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = sketches.keys(sketch) ^ mix(part.column(2).to_numpy().astype(np.uint64), 5)[:, None]  # vectors of a length
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(mix(keys[:, t], t).view(np.int64)), pa.array([t] * part.num_rows, pa.int32()), part.column(0), part.column(1)], names=["bucket", "t", "no", "sketch"])

    dealt = arrow_map(unique.select("no", "sketch", "size"), deal, "bucket long, t int, no long, sketch binary")

    def parts_of(table: pa.Table, *by: str):
        """(table number, rows from, rows to) of the buckets of two rows or more."""
        bucket, t = table["bucket"].to_numpy(), table["t"].to_numpy()
        new = np.ones(len(bucket), bool)
        new[1:] = False
        for own in (bucket, t, *(table[c].to_numpy() for c in by)):
            new[1:] |= own[1:] != own[:-1]
        begins = np.flatnonzero(new)
        for a, z in zip(begins.tolist(), np.append(begins[1:], len(bucket)).tolist()):
            if z - a > 1:
                yield int(t[a]), a, z

    def mark(batches):
        sketches = Sketches(bits, tables, seed)
        for table in _by_bucket(batches, 100_000):
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
            keys, words = sketches.keys(sketch), _words(sketch)
            side = table["side"].to_numpy() if "side" in table.column_names else np.zeros(table.num_rows, int)
            marked = np.zeros(table.num_rows, bool)
            for t, from_, to in parts_of(table):
                for a, b in _blocks(to - from_):
                    a, b = a + from_, b + from_
                    x, y = slice(a, min(a + BLOCK, to)), slice(b, min(b + BLOCK, to))
                    if marked[x].all() and marked[y].all():
                        continue
                    i, j = np.nonzero(_apart(words[x], words[y]) <= most)
                    i, j = i + a, j + b
                    up = (i < j) & ~(marked[i] & marked[j]) & ((side[i] != side[j]) | (side[i] == 0))
                    i, j = i[up], j[up]
                    first = _first_met(keys, t, i, j)
                    marked[i[first]] = marked[j[first]] = True
            at = np.flatnonzero(marked)
            if len(at):
                columns = [table[c].to_numpy()[at] for c in ("home" if "home" in table.column_names else "bucket", "t", "no")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "t", "no"])

    whole = counted <= bucket_rows  # no bucket can hold more
    near = dealt if whole else _split(dealt, bucket_rows)
    marked = arrow_map(near.repartition("bucket").sortWithinPartitions("bucket", "t"), mark, "bucket long, t int, no long")
    marked = materialize(marked if whole else marked.distinct(), "vec-marked")
    widest = unique.agg(F.max("size")).first()[0] or 1
    limit = max(2, bucket_bytes // widest)
    places = marked.withColumn("side", F.lit(0)) if counted <= limit else _split(marked, limit)
    # a vector is sent once with the places it goes to: its buckets, or their parts, in some of the tables
    wanted = places.groupBy("no").agg(F.collect_list(F.struct("bucket", "t", "side")).alias("at")).join(unique.select("no", "copies"), "no")
    sent = raw.select(F.col("row").alias("no"), "raw", "sketch").join(wanted, "no")
    sent = sent.select("no", "copies", "raw", "sketch", F.explode("at").alias("at")).select("at.*", "no", "copies", "raw", "sketch", F.length("raw").alias("size"))
    sent = sent.repartition("bucket").sortWithinPartitions("bucket", "t", "size")

    def search(batches):
        sketches = Sketches(bits, tables, seed)
        for table in _by_bucket(batches, 10_000):
            no, copies, side = (table[c].to_numpy() for c in ("no", "copies", "side"))
            raws = table["raw"].to_pylist()
            keys = sketches.keys(np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1))
            links = np.zeros(table.num_rows, np.int64)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t, from_, to in parts_of(table, "size"):
                unit = _matrix(raws[from_:to], kind)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                labels = np.arange(to - from_)
                for a, b in _blocks(to - from_):
                    i, j = np.nonzero(unit[a : a + BLOCK] @ unit[b : b + BLOCK].T >= threshold)
                    i, j = i + a + from_, j + b + from_
                    up = (i < j) & ((side[i] != side[j]) | (side[i] == 0))
                    i, j = i[up], j[up]
                    first = _first_met(keys, t, i, j)
                    i, j = i[first], j[first]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    merge_labels(labels, i - from_, j - from_)
                below = np.flatnonzero(labels != np.arange(to - from_))
                us.append(no[from_ + below])
                vs.append(no[from_ + labels[below]])
            at = np.flatnonzero(links)
            if len(at):
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                yield pa.RecordBatch.from_arrays([pa.array(no[at]), pa.nulls(len(at), pa.int64()), pa.array(links[at])], names=["u", "v", "links"])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["u", "v", "links"])

    made = materialize(arrow_map(sent, search, "u long, v long, links long"), "vec-links")
    linked = made.filter("links is not null").groupBy(F.col("u").alias("no")).agg(F.sum("links").alias("links"))
    # Components come first by the vectors' numbers, then as the smallest identifier in each.
    found = components(made.filter("v is not null").select("u", "v"))
    placed = unique.select("mark", "no", "rep", "copies").join(linked, "no", "left").join(found, F.col("no") == F.col("node"), "left")
    placed = placed.select("mark", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "no").alias("root"))
    placed = materialize(placed, "vec-placed")
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    placed = join_hot(placed, smallest, "root", "members").select("mark", "copies", "links", "component_id")
    # a row without a vector gets a mark that no vector has
    free = F.concat(F.lit(b"-"), F.unhex(F.hex("row")))
    out = join_hot(raw.select("vec_id", F.coalesce("mark", free).alias("mark")), placed, "mark", "copies")
    alone = F.col("copies").isNull()
    out = out.select("vec_id", F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
