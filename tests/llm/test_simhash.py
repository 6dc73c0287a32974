import random
import re

import numpy as np
import pytest
import xxhash

from siltstone.llm import simhash
from siltstone.llm.components import components, forest


def fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, edges):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def brute(rows, radius=4):
    prints = [fingerprint(t) for _, t in rows]
    code = np.array(prints, np.uint64)
    edges = [(i, int(j) + i + 1) for i in range(len(code)) for j in np.flatnonzero(np.bitwise_count(code[i] ^ code[i + 1 :]) <= radius)]
    of = reach(len(rows), edges)
    least = {}
    for (i, _), c in zip(rows, of):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, format(p, "016x"), least.get(c)) for (i, _), p, c in zip(rows, prints, of)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, bytes(r.code).hex(), r.component_id) for r in df.collect()), key=str)


def test_odd_rows(odd, texts):
    assert rows_of(simhash.near_dedup(odd)) == brute(texts)


def test_documents_with_split_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert rows_of(simhash.near_dedup(docs)) == want
    assert rows_of(simhash.near_dedup(docs, bucket_limit=2)) == want


def test_empty_table(none):
    assert simhash.near_dedup(none).count() == 0


@pytest.mark.parametrize("spread", [64, 20, 9])
def test_index_equals_brute_force(spread):
    """Random codes, and balls of near codes, in several buckets."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(spread, rng.integers(0, 7), replace=False)) for _ in range(900)], np.uint64)
    code = np.unique(centres[rng.integers(0, 4, 900)] ^ flips)
    bucket = rng.integers(0, 3, len(code))
    index = simhash.GrayIndex(bucket, code[:, None], np.arange(len(code)), 4)
    index.search()
    u, v = index.forest(np.arange(len(code)))
    edges = [(i, j) for i in range(len(code)) for j in range(i + 1, len(code)) if bucket[i] == bucket[j] and bin(int(code[i] ^ code[j])).count("1") <= 4]
    assert reach(len(code), zip(u.tolist(), v.tolist())) == reach(len(code), edges)


def test_gray_rank():
    codes = np.array([n ^ (n >> 1) for n in range(300)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(300))


def test_blocks_find_every_link():
    for tables, bits, radius in ((simhash.exact_tables(64, 4), 64, 4), (simhash.exact_tables(64, 7), 64, 7)):
        assert sorted(b for t in tables for b in t) == list(range(bits)) and len(tables) == radius + 1


def test_wide_fingerprints_find_similar_texts(spark):
    """Texts of Jaccard similarity 0.8 or more on five words are linked, others aren't."""
    rng = random.Random(2)
    rows, want = [], 0
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((2 * k, " ".join(words)))
        other = list(words)
        for at in rng.sample(range(400), 5):
            other[at] = "changed" + str(at)
        rows.append((2 * k + 1, " ".join(other)))
    out = {r.doc_id: r.component_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=5, words=4, radius=44, recall=0.9).collect()}
    found = sum(out[2 * k + 1] == 2 * k for k in range(150))
    assert found >= 143 and all(out[2 * k] == 2 * k for k in range(150)) and all(out[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(150))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(400, 700)] + [(0, rng.randrange(1, 300)) for _ in range(500)] + [(a := rng.randrange(800, 1500), a) for _ in range(20)]
    edges += [(rng.randrange(800, 1500), rng.randrange(800, 1500)) for _ in range(300)]
    of = reach(1500, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {n: c for n, c in enumerate(of) if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    u, v = forest(np.array([5, 7, 9]), np.array([7, 9, 100]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(7, 5), (9, 5), (100, 5)]


def test_exact_tables_of_more_blocks():
    """Any two codes within the radius agree on all bits of one table at least, whatever the number of rows."""
    from itertools import combinations

    for rows, count in ((0, 5), (5 * 10**5, 5), (10**7, 15), (10**12, 35)):
        tables = simhash.exact_tables(64, 4, rows)
        assert len(tables) == count
        rng = np.random.default_rng(rows)
        for _ in range(200):
            changed = set(rng.choice(64, 4, replace=False).tolist())
            assert any(changed.isdisjoint(t) for t in tables)
    for rows in (10**7, 10**12):
        tables = simhash.exact_tables(12, 2, rows)
        assert all(any(set(c).isdisjoint(t) for t in tables) for c in combinations(range(12), 2))
