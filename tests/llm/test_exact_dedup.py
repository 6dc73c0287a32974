import hashlib
import random

import numpy as np
import pytest

from siltstone.llm import exact_dedup


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        stays = keep(ids) if ids else None
        out.append((i, stays, len(groups[t or ""]), i == stays))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("width", [32, 1])
def test_odd_rows(odd, texts, keep, width):
    """A digest of one byte makes different texts collide, so the verification has to part them."""
    got = exact_dedup.exact_dedup(odd, keep=keep, digest_bytes=width, memtable=4, fan_in=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(texts, min if keep == "min" else max)
    if width == 32:
        assert {bytes(r.digest) for r in got} == {hashlib.sha256((t or "").encode()).digest() for _, t in texts}


def test_many_collisions_and_a_hot_group(spark):
    rows = [(i, f"text {i % 700}" if i % 3 else "the same text") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for width in (1, 32):
        got = exact_dedup.exact_dedup(df, keep="max", digest_bytes=width, memtable=100).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows, max)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_the_first_and_the_last_identifier(spark, keep):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "a"), (most, "a"), (most, "b"), (None, "b"), (None, "c"), (None, "c"), (least, "d"), (None, "d"), (3, "d"), (most, "e")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows, min if keep == "min" else max)


def test_one_row_that_repeats(spark):
    rows = [(None, "the same row")] * 1500 + [(5, "another one")] * 1500 + [(i, f"text {i}") for i in range(1500)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep="max").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows, max)


def test_empty_table(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def test_merge_index():
    rng = random.Random(1)
    index, want = exact_dedup.MergeIndex(memtable=50, fan_in=3), {}
    for _ in range(60):
        keys = [hashlib.sha256(str(rng.randrange(300)).encode()).digest() for _ in range(20)]
        ids = [rng.randrange(10**6) for _ in keys]
        index.put(np.array(keys, "S32"), np.array(ids, np.int64), np.ones(20, np.int64))
        for k, i in zip(keys, ids):
            a, n = want.get(k, (i, 0))
            want[k] = (min(a, i), n + 1)
        assert len(index.runs) < 3
    run = index.all()
    assert {k.ljust(32, b"\0"): (f, n) for k, f, n in zip(run.digest.tolist(), run.first.tolist(), run.count.tolist())} == want
    assert run.digest.tolist() == sorted(run.digest.tolist())
    assert (run.find(np.array([b"no such digest"], "S32")) == -1).all()
