"""SimHash near-dedup by a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of its word shingles' hashes have it. Equal
fingerprints are one from here on. Fingerprints within `radius` bits of each other are linked. To deal the work
out, each goes to several tables by some of its bits: for an exact search, the bits fall into radius + g blocks,
of which two linked fingerprints share g, and there is a table for each choice of g (g by the number of rows); of a wide fingerprint, tables take random bits, as many tables as a
link at the radius needs to be found with the wanted probability.

In a bucket, fingerprints are sorted by Gray rank, so that neighbours differ in few bits. Runs of neighbours form
nodes, runs of nodes upper nodes; a node holds the bits that all below it share and their pattern. Two nodes
whose shared bits already differ in more than the radius are pruned with all below them, and so are two whose
members are known to be connected. What a bucket returns is a forest of its links, never their pairs. Components
over all forests are found by distributed stars.

Buckets of more than BUCKET fingerprints are split into salted parts, and each pair of parts is searched, so no
link is lost. Texts: null counts as empty; a text of fewer words than a shingle is one shingle; no word at all
gives fingerprint zero, which links like any other. Rows that repeat an identifier get equal rows; null
identifiers get a component only through others with one. Other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_hot, materialize, text_of
from .components import components, merge_labels
from .mph import mix

#: Distinct fingerprints that one bucket may hold before it is split.
BUCKET = 1_000_000
#: Rows that a worker searches together, at most (but for one bucket that has more).
CHUNK = 150_000
FAN = 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    s = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not s:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(s, np.uint8) == 32).tolist()
    digest = xxhash.xxh64_intdigest
    if len(gaps) < size:
        return np.array([digest(s, seed)], np.uint64)
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(s)]
    return np.array([digest(s[i:j], seed) for i, j in zip(starts, ends[size - 1 :])], np.uint64)


def fingerprints_of(texts: list[str], size: int, seed: int, words: int) -> np.ndarray:
    """Rows of `words` 64-bit fingerprints; the first is that of the hashes, the others of hashes derived from them."""
    return _fingerprints_of_hashes([shingle_hashes(t or "", size, seed) for t in texts], words)


def _fingerprints_of_hashes(hashes: list[np.ndarray], words: int) -> np.ndarray:
    n = np.array([len(h) for h in hashes])
    flat, owner = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(hashes)), n) * 256
    out = np.zeros((len(hashes), words), np.uint64)
    for w in range(words):
        lanes = (mix(flat, 7919 * w) if w else flat).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts = np.bincount(owner + lanes[:, k], minlength=256 * len(hashes)).reshape(-1, 256) @ _BITS
            byte = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")[:, 0]
            out[:, w] |= byte.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, code binary (8 bytes a word, most significant first)."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                codes = fingerprints_of(part.column(1).to_pylist(), size, seed, words).astype(">u8").tobytes()
                raw = [codes[i : i + 8 * words] for i in range(0, len(codes), 8 * words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["doc_id", "code"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, "doc_id long, code binary")


def exact_tables(bits: int, radius: int, rows: int = 0, alike: int = 128) -> list[list[int]]:
    """The bits fall into radius + g blocks; codes within the radius agree on g of them at least, so there is a table
    for each choice of g. More of them make longer keys: g is the least for which about `alike` or fewer of `rows`
    unlike codes meet in a bucket (at most 3 and never more blocks than bits), a rule that is exact for any g."""
    for g in (1, 2, 3):
        blocks = radius + g
        if blocks > bits:
            break
        cuts = [round(k * bits / blocks) for k in range(blocks + 1)]
        parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]
        tables = [[p for part in chosen for p in part] for chosen in combinations(parts, g)]
        if rows <= alike << min(map(len, tables)):
            break
    return tables


def random_tables(bits: int, radius: int, rows: int, recall: float, seed: int = 1) -> list[list[int]]:
    """As many tables as find a link at `radius` with probability `recall`, each of so many bits that about 2^7
    unlike codes meet in a bucket: a rule of the number of rows, the same at every size."""
    take = min(max(8, math.ceil(math.log2(max(2, rows))) - 7), bits // 4)
    alike = math.prod((bits - radius - i) / (bits - i) for i in range(take))
    count = math.ceil(math.log(1 - recall) / math.log(1 - alike))
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, take, replace=False).tolist()) for _ in range(count)]


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Where a code stands in the order of the reflected Gray code."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class GrayIndex:
    """Over codes (n, words) in buckets. `labels` is the local component of each row."""

    def __init__(self, bucket: np.ndarray, code: np.ndarray, same: np.ndarray, radius: int):
        """same: rows of equal `same` are one vertex."""
        ranks = [gray_rank(code[:, w]) for w in range(code.shape[1])]
        order = np.lexsort((*ranks[::-1], bucket))
        self.order, self.bucket, self.code, self.radius = order, bucket[order], code[order], radius
        _, self.vertex = np.unique(same[order], return_inverse=True)
        self.labels = np.arange(self.vertex.max() + 1 if len(order) else 0)
        self.levels: list[dict] = []
        n = len(order)
        group, low, high = self.bucket, self.code, self.code
        first = np.arange(n)
        while True:  # nodes of up to FAN neighbours of one bucket
            m = len(group)
            new = np.ones(m, bool)
            new[1:] = group[1:] != group[:-1]
            begins = np.flatnonzero(new)
            place = np.arange(m) - np.repeat(begins, np.diff(np.append(begins, m)))
            cut = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, cut, axis=0), np.bitwise_or.reduceat(high, cut, axis=0)
            first = first[cut]
            self.levels.append({"child": np.append(cut, m), "low": low, "shared": ~(low ^ high), "first": first})
            group = group[cut]
            if len(np.unique(group)) == len(group):
                break

    def _whole(self) -> list[np.ndarray]:
        """By level, the component of a node's rows, or -1 if they have several."""
        of = self.labels[self.vertex]
        return [np.where((a := np.minimum.reduceat(of, x["first"])) == np.maximum.reduceat(of, x["first"]), a, -1) for x in self.levels]

    def search(self, verify: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """With `verify`, a link counts only if it holds of the rows; rows known to be connected aren't asked about."""
        n = len(self.order)
        if n < 2:
            return
        near = np.flatnonzero((self.bucket[1:] == self.bucket[:-1]) & (_distance(self.code[1:] ^ self.code[:-1]) <= self.radius))
        self._link(near, near + 1, verify)
        top, step = len(self.levels) - 1, 4096 // self.code.shape[1]  # pairs of nodes at a time
        roots = np.arange(len(self.levels[top]["low"]))
        stack, whole, changed = [(top, roots, roots)], self._whole(), False
        while stack:
            level, a, b = stack.pop()
            if len(a) > step:
                stack += [(level, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]
                continue
            if changed:
                whole, changed = self._whole(), False
            x = self.levels[level]
            keep = (whole[level][a] < 0) | (whole[level][a] != whole[level][b])
            a, b = a[keep], b[keep]
            apart = _distance((x["low"][a] ^ x["low"][b]) & x["shared"][a] & x["shared"][b])
            a, b = a[apart <= self.radius], b[apart <= self.radius]
            if not len(a):
                continue
            ka, kb = x["child"][a + 1] - x["child"][a], x["child"][b + 1] - x["child"][b]
            count = ka * kb
            pair = np.repeat(np.arange(len(a)), count)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            i = x["child"][a][pair] + within // kb[pair]
            j = x["child"][b][pair] + within % kb[pair]
            once = (a[pair] != b[pair]) | (i < j if level == 0 else i <= j)
            i, j = i[once], j[once]
            if level:
                stack.append((level - 1, i, j))
                continue
            link = _distance(self.code[i] ^ self.code[j]) <= self.radius
            changed = self._link(i[link], j[link], verify)

    def _link(self, i: np.ndarray, j: np.ndarray, verify: Callable | None) -> bool:
        if verify is None:
            return merge_labels(self.labels, self.vertex[i], self.vertex[j])
        nearest = np.argsort(_distance(self.code[i] ^ self.code[j]), kind="stable")
        i, j, changed, step = i[nearest], j[nearest], False, 256
        while len(i):
            apart = self.labels[self.vertex[i]] != self.labels[self.vertex[j]]
            i, j = i[apart], j[apart]
            a, b = i[:step], j[:step]
            held = verify(self.order[a], self.order[b])
            changed |= merge_labels(self.labels, self.vertex[a[held]], self.vertex[b[held]])
            i, j, step = i[step:], j[step:], 2 * step
        return changed

    def forest(self, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges (rep of a vertex, rep of its component's first vertex)."""
        of = np.zeros(len(self.labels), np.int64)
        of[self.vertex] = rep[self.order]
        below = np.flatnonzero(self.labels != np.arange(len(self.labels)))
        return of[below], of[self.labels[below]]


def _search(batches, words: int, radius: int):
    """Batches of bucket, code, rep, sorted by bucket."""
    held: list[tuple] = []
    rows = 0

    def found(parts):
        bucket, code, rep = (np.concatenate(x) for x in zip(*parts))
        lone = np.ones(len(bucket), bool)
        lone[1:] &= bucket[1:] != bucket[:-1]
        lone[:-1] &= bucket[1:] != bucket[:-1]
        bucket, code, rep = bucket[~lone], code[~lone], rep[~lone]
        if len(bucket):
            index = GrayIndex(bucket, code, rep, radius)
            index.search()
            u, v = index.forest(rep)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column(0).to_numpy()
        code = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
        held.append((bucket, code, b.column(2).to_numpy()))
        rows += len(bucket)
        if rows >= CHUNK:
            last = held[-1][0][-1]
            cut = int(np.searchsorted(bucket, last)) if bucket[0] != last else 0
            if cut == 0 and len(held) > 1 and held[0][0][0] == last:
                continue  # all one bucket so far
            if cut == 0:  # the last bucket began in an earlier batch
                whole = tuple(np.concatenate(x) for x in zip(*held))
                at = int(np.searchsorted(whole[0], last))
                ready, held = [tuple(x[:at] for x in whole)], [tuple(x[at:] for x in whole)]
            else:
                ready, held = [*held[:-1], tuple(x[:cut] for x in held[-1])], [tuple(x[cut:] for x in held[-1])]
            rows = sum(len(x[0]) for x in held)
            if len(ready[0][0]):
                yield from found(ready)
    if held:
        yield from found(held)


def links(codes: DataFrame, words: int, radius: int, tables: list[list[int]], bucket_limit: int = BUCKET) -> DataFrame:
    """codes: code binary (distinct), rep long (a vertex of its own for each). Returns u, v: forests of the links."""

    def deal(batches):
        picks = [np.array([63 - p % 64 + 64 * (p // 64) for p in t]) for t in tables]  # bit p of word p // 64
        for b in batches:
            for k in range(0, b.num_rows, 4000):
                part = b.slice(k, 4000)
                raw = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(raw, axis=1)
                buckets = []
                for t, pick in enumerate(picks):
                    key = np.zeros((part.num_rows, 8), np.uint8)
                    packed = np.packbits(bits[:, pick], axis=1)
                    key[:, : packed.shape[1]] = packed[:, :8]
                    buckets.append(mix(key.view(np.uint64).reshape(-1), t).view(np.int64))
                for bucket in buckets:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column(0), part.column(1)], names=["bucket", "code", "rep"])

    dealt = arrow_map(codes.select("code", "rep"), deal, "bucket long, code binary, rep long")
    if codes.count() > bucket_limit:  # else no bucket can hold more
        dealt = _split(dealt, bucket_limit)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return arrow_map(dealt, lambda it: _search(it, words, radius), "u long, v long")


def _split(dealt: DataFrame, bucket_limit: int, salt: str = "code") -> DataFrame:
    """Buckets of more than bucket_limit rows become buckets of each pair of their parts, salted by a column."""
    others = [c for c in dealt.columns if c != "bucket"]
    large = materialize(dealt.groupBy("bucket").count().filter(F.col("count") > bucket_limit), "simhash-large")
    parts = F.ceil(F.col("count") / (bucket_limit / 2))
    own = F.pmod(F.xxhash64(salt), parts)
    split = dealt.join(large, "bucket").withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    split = split.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), *others)
    return dealt.join(large, "bucket", "left_anti").unionByName(split)


def near_dedup(docs: DataFrame, size: int = 4, seed: int = 42, words: int = 1, radius: int = 4, recall: float | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET) -> DataFrame:
    """One row per row: doc_id, code binary, component_id (the smallest doc_id reachable by links). With recall
    None the search is exact; else tables of random bits find a link at the radius with that probability."""
    prints = materialize(fingerprints(docs, size, seed, words, id_col, text_col), "simhash-prints")
    codes = materialize(prints.groupBy("code").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "simhash-codes")
    known = codes.filter("rep is not null")
    bits = 64 * words
    rows = codes.count()
    tables = exact_tables(bits, radius, rows) if recall is None else random_tables(bits, radius, rows, recall)
    found = components(links(known, words, radius, tables, bucket_limit))
    placed = codes.join(found, codes.rep == found.node, "left").select("code", F.coalesce("component", "rep").alias("component_id"), "rows")
    return join_hot(prints, placed, "code", "rows").select("doc_id", "code", "component_id")


def shingle_set(text: str | None, size: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes, in the order of hashes derived from them."""
    held = np.unique(shingle_hashes(text or "", size, seed))
    return held[np.argsort(mix(held, 3), kind="stable")]


def _set_key(held: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(held.tobytes())


def same_share(sets: list[np.ndarray], percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of rows i and j: whether their sets have a Jaccard similarity of `percent` or more."""
    n = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(n) - n
    members, flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    marked = np.zeros(len(members), bool)

    def verify(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        fit = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        fit = fit[np.argsort(i[fit], kind="stable")]
        cuts = np.flatnonzero(np.diff(i[fit], prepend=-1))
        for at in np.split(fit, cuts[1:]) if len(fit) else ():
            one = i[at[0]]
            own = flat[starts[one] : starts[one] + n[one]]
            marked[own] = True
            for part in np.array_split(at, 1 + int(n[j[at]].sum() >> 20)):
                both = np.zeros(len(part), np.int64)
                if len(part) == 1:
                    both[0] = marked[flat[starts[j[part[0]]] : starts[j[part[0]]] + n[j[part[0]]]]].sum()
                elif len(part):
                    size = n[j[part]]
                    ends = np.cumsum(size)
                    place = np.arange(ends[-1]) + np.repeat(starts[j[part]] - (ends - size), size)
                    total = np.concatenate([[0], np.cumsum(marked[flat[place]])])
                    both = total[ends] - total[ends - size]
                out[part] = 100 * both >= percent * (n[one] + n[j[part]] - both)
            marked[own] = False
        return out

    return verify


def _whole_buckets(batches, least: int):
    """Tables of whole buckets (first column, sorted) of `least` bytes or a bucket more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column(0).to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if held and bucket[0] != held[-1].column(0)[-1].as_py() and sum(x.get_total_buffer_size() for x in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
        if cut and sum(x.get_total_buffer_size() for x in [*held, b]) >= least:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
            b = b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def near_sets(docs: DataFrame, percent: int, radius: int, size: int = 5, seed: int = 42, words: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = 20_000) -> DataFrame:
    """node, component: each doc_id that isn't the smallest of those it is linked to, and the smallest. Linked are
    texts whose sets of shingles have a Jaccard similarity of `percent` or more, directly or through others.

    Blocks are exact: two such sets share one of the first n - ceil(percent n) + 1 members of each, in any one order,
    so a text goes to a bucket for each of these. There the Gray-order index links fingerprints (of distinct
    shingles) within `radius`, wide enough to lose nothing. Texts connected so far come together with their words, and
    the index searches them again; there a link counts only if the sets hold it. Equal sets are one vertex, texts
    without words too. Rows that repeat a doc_id are one document. Null doc_ids take no part."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                sets = [shingle_set(t, size, seed) for t in part.column(1).to_pylist()]
                codes = _fingerprints_of_hashes(sets, words).astype(">u8").tobytes()
                raw = [codes[i : i + 8 * words] for i in range(0, len(codes), 8 * words)]
                first = [x[: len(x) + 1 - -(-percent * len(x) // 100)].tobytes() if len(x) else b"" for x in sets]
                columns = [part.column(0), *(pa.array(x, pa.binary()) for x in ([_set_key(x) for x in sets], raw, first))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set", "code", "first"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).filter("doc_id is not null")
    prints = materialize(arrow_map(source, run, "doc_id long, set binary, code binary, first binary"), "near-prints")
    nodes = prints.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("code").alias("code"), F.first("first").alias("first"))
    nodes = materialize(nodes.withColumn("vertex", F.monotonically_increasing_id()), "near-nodes")

    def deal(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                first = part.column(1).to_pylist()
                at = pa.array(np.repeat(np.arange(len(first)), [len(x) // 8 for x in first]))
                bucket = np.frombuffer(b"".join(first), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column(0).take(at), part.column(2).take(at)], names=["bucket", "code", "rep"])

    dealt = arrow_map(nodes.select("code", "first", "vertex"), deal, "bucket long, code binary, rep long")
    if nodes.count() > BUCKET:
        dealt = _split(dealt, BUCKET)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    near = components(arrow_map(dealt, lambda it: _search(it, words, radius), "u long, v long"))
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    near = nodes.join(near, nodes.vertex == near.node).select("component", "vertex", "rep", "set", "code")
    texts = near.join(source, near.rep == source.doc_id).select(F.col("component").alias("bucket"), "vertex", "rep", "set", "code", "text")
    if near.count() > bucket_limit:
        texts = _split(texts, bucket_limit, "vertex")

    def compare(batches):
        for table in _whole_buckets(batches, 4 << 20):
            columns = dict(zip(table.column_names, table.columns))
            sets = [shingle_set(t, size, seed) for t in columns["text"].to_pylist()]
            # rows that repeat an identifier may have other texts
            own = np.array([_set_key(x) == k for x, k in zip(sets, columns["set"].to_pylist())])
            sets = [x for x, o in zip(sets, own) if o]
            bucket, vertex, rep = (columns[c].to_numpy()[own] for c in ("bucket", "vertex", "rep"))
            code = np.frombuffer(b"".join(columns["code"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)[own]
            index = GrayIndex(bucket, code, vertex, radius)
            index.search(same_share(sets, percent))
            u, v = index.forest(rep)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held = arrow_map(texts.repartition("bucket").sortWithinPartitions("bucket"), compare, "u long, v long")
    equal = join_hot(prints.select("doc_id", "set"), nodes.select("set", "rep", "rows"), "set", "rows").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    return components(held.unionByName(equal))
