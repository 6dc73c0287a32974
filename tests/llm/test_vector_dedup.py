import numpy as np
import pytest

from siltstone.llm import vector_dedup

from .test_simhash import reach


def brute(rows, threshold=0.95):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) else None for _, v in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    of, links, least = reach(len(rows), edges), [0] * len(rows), {}
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    for (i, _), c in zip(rows, of):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, n, least.get(c)) for (i, _), n, c in zip(rows, links, of)), key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, True) for i, v in rows], "vec_id long, embedding array<float>, label int, kept boolean")


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0])]
    rows += [(9, [2.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (14, [-1.0, 0.0]), (15, [1e-30, 0.0])]
    assert rows_of(vector_dedup.near_vectors(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert vector_dedup.near_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [{}, dict(bucket_rows=10), dict(bucket_bytes=1300), dict(bucket_rows=20, bucket_bytes=1300)])
def test_recall(spark, limits):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + rng.uniform(0, 0.24) * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(600)]
    got, want = rows_of(vector_dedup.near_vectors(frame(spark, rows), **limits)), brute(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all_links > 500 and found >= 0.99 * all_links
    assert all(a[1] <= b[1] for a, b in zip(sorted(got), sorted(want)))


def test_plan_keeps_its_recall():
    for n in (10, 10**4, 10**7, 10**10):
        bits, tables = vector_dedup.plan(n, 0.95, 0.99)
        most = vector_dedup.furthest(bits * tables, 0.95)
        assert most < bits * tables / 2 - 2 * np.sqrt(bits * tables / 4)  # parts linked vectors from unlike ones
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.99 and bits <= 62
