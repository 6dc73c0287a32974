"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Each document gives the distinct 128-bit
hashes of its keys of at least `min_chars` code points; these are summed to (first document, last document, count)
per hash, and hashes of one document only are dropped. What is left is dealt into shards. Each shard builds a
minimal perfect hash with a fingerprint, a count and a first-document array. Documents probe those arrays and drop
the lines that another document holds first: no line is joined.

How the arrays reach the documents depends on their measured size. Up to `broadcast_bytes` every worker gets all
shards. Beyond that, the documents' hashes go to the shards: the hottest hashes are one small shard that all
workers have, the others are probed where their shard lies, and the lines to drop go back to their documents.

Texts: null or empty is one empty line. Lines are those between \\n; a document whose lines are all dropped has an
empty text. Rows that repeat a doc_id are one document: none of their lines counts as another's. A null doc_id
comes after all others as holder of a line. An empty table gives an empty one. All columns of the input are kept;
n_lines and n_dropped replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, arrow_map, materialize
from .mph import HashIndex, mix

SHARD_KEYS = 500_000
#: Hashes that one group of a shard is asked at a time, about.
QUESTIONS = 1_000_000
BROADCAST_BYTES = 64 << 20
_LAST = np.iinfo(np.int64).max
_SPACE = b" \t\n\x0b\x0c\r"


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least


def line_hashes(text: str | None, least: int) -> list[tuple[int, bytes]]:
    """(place of the line, 16-byte hash of its key) of the lines that count."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    digest = xxhash.xxh3_128_digest
    return [(i, digest(key)) for i, x in enumerate(lines) if _long_enough(key := x.strip(_SPACE), least)]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def repeated_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """hi, lo, first long, n long of the keys that at least two documents hold."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                found = [list({h for _, h in line_hashes(t, min_chars)}) for t in part.column(1).to_pylist()]
                hi, lo = _halves([h for x in found for h in x])
                owner = np.repeat(_ids(part.column(0)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(owner)], names=["hi", "lo", "doc"])

    keys = arrow_map(docs.select(id_col, text_col), run, "hi long, lo long, doc long")
    return keys.groupBy("hi", "lo").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).filter("first < last").drop("last")


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """shard int, blob binary: one row per shard that has keys."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            columns = [b.column(k).to_numpy() for k in range(4)]
            shard = b.column(4).to_numpy()
            for s in np.unique(shard).tolist():
                held.setdefault(s, []).append([c[shard == s] for c in columns])
        for s, parts in held.items():
            hi, lo, first, n = (np.concatenate(x) for x in zip(*parts))
            index = HashIndex(hi.view(np.uint64), lo.view(np.uint64), first, n)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([index.dump()], pa.binary())], names=["shard", "blob"])

    dealt = keys.select("hi", "lo", "first", "n", F.pmod("hi", F.lit(shards)).cast("int").alias("shard")).repartition("shard")
    return arrow_map(dealt, run, "shard int, blob binary")


def _probe(index: dict[int, HashIndex], shards: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shard = hi.view(np.int64) % shards  # as pmod
    found, first = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
    for s, one in index.items():
        at = np.flatnonzero(shard == s) if shards > 1 else np.arange(len(hi))
        if len(at):
            found[at], first[at] = one.probe(hi[at], lo[at])
    return found, first


def _rewrite(part: pa.RecordBatch, dropped: list, text_at: int, out_names: list[str]) -> pa.RecordBatch:
    """dropped: for each row the set of lines to drop, or nothing."""
    texts, n_lines, n_dropped = part.column(text_at).to_pylist(), [], []
    for i, (text, gone) in enumerate(zip(texts, dropped)):
        n_lines.append((text or "").count("\n") + 1)
        n_dropped.append(len(gone) if gone else 0)
        if gone:
            texts[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    columns = {part.schema.field(k).name: part.column(k) for k in range(part.num_columns)}
    columns[part.schema.field(text_at).name] = pa.array(texts, pa.string())
    columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
    return pa.RecordBatch.from_arrays([columns[n] for n in out_names], names=out_names)


def line_dedup(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, questions: int = QUESTIONS) -> DataFrame:
    """The input's rows, their texts without the lines that a smaller document holds, with n_lines and n_dropped
    long. The index is built when this is called."""
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c in docs.columns and c not in (id_col, text_col)])
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    keys = materialize(repeated_keys(docs, id_col, text_col, min_chars), "line-keys")
    shards = max(1, -(-keys.count() // shard_keys))
    index = materialize(build_shards(keys, shards), "line-shards")
    size = index.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    out_names = [*docs.columns, "n_lines", "n_dropped"]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    sc = docs.sparkSession.sparkContext
    if size <= broadcast_bytes:
        blobs = sc.broadcast([(r.shard, bytes(r.blob)) for r in index.collect()])

        def run(batches):
            own = {s: HashIndex.load(x) for s, x in blobs.value}
            for b in batches:
                for k in range(0, b.num_rows, 1000):
                    part = b.slice(k, 1000)
                    found = [line_hashes(t, min_chars) for t in part.column(text_at).to_pylist()]
                    n = [len(x) for x in found]
                    dropped: list = [None] * len(found)
                    if sum(n):
                        hi, lo = _halves([h for x in found for _, h in x])
                        held, first = _probe(own, shards, hi, lo)
                        doc = np.repeat(_ids(part.column(id_at)), n)
                        row, line = np.repeat(np.arange(len(n)), n), np.array([i for x in found for i, _ in x])
                        gone = held & (first != doc)
                        for r, i in zip(row[gone].tolist(), line[gone].tolist()):
                            dropped[r] = dropped[r] or set()
                            dropped[r].add(i)
                    yield _rewrite(part, dropped, text_at, out_names)

        return arrow_map(docs, run, schema)
    return _routed(docs, keys, index, shards, min_chars, id_col, text_col, schema, out_names, questions)


def _routed(docs, keys, index, shards, min_chars, id_col, text_col, schema, out_names, questions) -> DataFrame:
    """The arrays stay in their shards and the hashes come to them. Lines to drop come back by the number of the row,
    as rows may share an identifier."""
    sc = docs.sparkSession.sparkContext
    docs_names = list(docs.columns)
    docs = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "line-rows")
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    # Of all keys, the heaviest by their count: no other has more than 1/HOT_KEYS of the rows to deal.
    top = keys.orderBy(F.col("n").desc(), "hi", "lo").limit(HOT_KEYS).collect()
    hot = sc.broadcast(HashIndex(np.array([r.hi for r in top], np.int64).view(np.uint64), np.array([r.lo for r in top], np.int64).view(np.uint64), np.array([r["first"] for r in top], np.int64), np.array([r.n for r in top], np.int64)).dump())

    def ask(batches):
        near = HashIndex.load(hot.value)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                found = [line_hashes(t, min_chars) for t in part.column(1).to_pylist()]
                n = [len(x) for x in found]
                if not sum(n):
                    continue
                hi, lo = _halves([h for x in found for _, h in x])
                doc, line = np.repeat(_ids(part.column(0)), n), np.array([i for x in found for i, _ in x], np.int64)
                row = np.repeat(part.column(2).to_numpy(), n)
                held, first = near.probe(hi, lo)
                own = held & (first == doc)  # these stay and need no answer
                # a shard below 0: answered here, spread by row
                shard = np.where(held, -1 - (mix(row.view(np.uint64), 5) >> np.uint64(40)).astype(np.int64), hi.view(np.int64) % shards)
                sub = np.where(held, 0, (mix(row.view(np.uint64), 6) % np.uint64(1 << 30)).astype(np.int64))
                columns = [shard, sub, hi.view(np.int64), lo.view(np.int64), doc, row, line, held]
                yield pa.RecordBatch.from_arrays([pa.array(c[~own]) for c in columns], names=["shard", "sub", "hi", "lo", "doc", "row", "line", "known"])

    asked = arrow_map(docs.select(id_col, text_col, "__row"), ask, "shard long, sub long, hi long, lo long, doc long, row long, line long, known boolean")
    known = asked.filter("known").select("row", "line")

    def answer(key, left, right):
        blobs = right.column("blob").to_pylist()
        if not blobs or not left.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "line": pa.array([], pa.int64())})
        one = HashIndex.load(blobs[0])
        held, first = one.probe(left.column("hi").to_numpy().view(np.uint64), left.column("lo").to_numpy().view(np.uint64))
        doc = left.column("doc").to_numpy()
        gone = held & (first != doc)
        return pa.table({"row": pa.array(left.column("row").to_numpy()[gone]), "line": pa.array(left.column("line").to_numpy()[gone])})

    # A shard's questions are dealt to as many slices as keep each near QUESTIONS; each slice gets the shard's arrays.
    # `n` counts the documents that hold a key, so the sum over a shard's keys is what it is asked, but for lines that
    # a document repeats. The keys answered above aren't asked.
    asks = {r.shard: r.n for r in keys.groupBy(F.pmod("hi", F.lit(shards)).alias("shard")).agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    for r in top:
        asks[r.hi % shards] -= r.n
    slices = max(1, -(-max(asks.values(), default=0) // questions))
    far = asked.filter("not known").withColumn("slice", F.pmod("sub", F.lit(slices)))
    copies = index.select(F.col("shard").cast("long").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), "blob")
    answered = far.groupBy("shard", "slice").cogroup(copies.groupBy("shard", "slice")).applyInArrow(answer, "row long, line long")
    gone = known.unionByName(answered).groupBy("row").agg(F.collect_set("line").alias("__gone")).withColumnRenamed("row", "__drow")
    joined = docs.join(gone, F.col("__row") == F.col("__drow"), "left").select(*docs_names, "__gone")

    def run(batches):
        for b in batches:
            gone_at = b.num_columns - 1
            dropped = [set(x) if x else None for x in b.column(gone_at).to_pylist()]
            bare = pa.RecordBatch.from_arrays(b.columns[:gone_at], names=docs_names)
            yield _rewrite(bare, dropped, text_at, out_names)

    return arrow_map(joined, run, schema)
