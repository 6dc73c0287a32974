from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from siltstone.operators import aggregates, joins, relational, statistics, windows
from siltstone.sources.scratch import folder


def test_not_in_and_null(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    others = lambda *v: spark.createDataFrame([(x,) for x in v], "w int")
    got = lambda o: sorted(map(tuple, joins.not_in(left, "a", o, "w").collect()), key=str)
    assert got(others(1)) == [(2,)] and got(others(1, None)) == [] and got(others()) == [(1,), (2,), (None,)]


def test_compare_all_with_null_and_empty(spark):
    left = spark.createDataFrame([(1,), (5,)], "a int")
    others = lambda *v: spark.createDataFrame([(x,) for x in v], "w int")
    got = lambda o, some: sorted(r[0] for r in relational.compare_all(left, "a", ">", o, "w", some).collect())
    assert got(others(3), False) == [5] and got(others(3, None), False) == [] and got(others(), False) == [1, 5]
    assert got(others(3, None), True) == [5] and got(others(), True) == []


def test_dependencies(spark):
    df = spark.createDataFrame([(i, i % 4, (i % 4) // 2, i % 3) for i in range(60)], "id int, a int, b int, c int")
    assert statistics.discover_dependencies(df, 1.0) == [("a", "b")]
    assert not statistics.holds(df, "b", "a")


def test_grouping_sets_read_once(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = relational.grouping_sets(df, [["l_returnflag"], []], {"n": ("count", "*")})
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert sum(r["n"] for r in out.filter("l_returnflag is null").collect()) == df.count()
    assert relational.grouping_sets(df.limit(0), [[]], {"n": ("count", "*")}).count() == 1


def test_range_join(spark):
    points = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    spans = spark.createDataFrame([(1, 2.5, 7.0), (2, 6.0, 6.0)], "s int, lo double, hi double")
    out = joins.range_join(points, "x", spans, "lo", "hi", 2.0)
    assert sorted((r.s, r.x) for r in out.collect()) == [(1, float(i)) for i in range(3, 8)] + [(2, 6.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=25))
def test_distinct_counts(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: r.distinct_count for r in aggregates.distinct_count_by_group(df, ["g"], "v").collect()}
    assert got == {g: len({v for x, v in rows if x == g and v is not None}) for g in {g for g, _ in rows}}
    sums = aggregates.affine_sums(df, "v", [0, 3]).first()
    known = [v for _, v in rows if v is not None]
    assert tuple(sums) == ((sum(known), sum(v + 3 for v in known)) if known else (None, None))


def test_moving_window(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "i int, v double")
    out = df.withColumn("g", F.lit(1)).select("i", windows.moving(F.sum("v"), 2, ["g"], "i").alias("s"))
    assert [r.s for r in out.orderBy("i").collect()] == [0, 1, 3, 6, 9, 12]


def test_quantiles_of_a_frequent_value(spark, monkeypatch):
    """A value that most rows have is counted before it is dealt, so no range holds its rows."""
    written = []
    monkeypatch.setattr(aggregates, "folder", lambda s, name: written.append(folder(s, name)) or written[-1], raising=False)
    df = spark.range(40_000).selectExpr("id % 2 AS g", "IF(id < 36000, 5.5D, CAST(id AS DOUBLE)) AS v")
    out = aggregates.quantiles(df, ["g"], {"m": (F.col("v"), 0.5, True), "d": (F.col("v"), 0.9, False), "h": (F.col("v"), 0.95, True)})
    assert sorted(map(tuple, out.collect())) == [(0, 5.5, 5.5, 37998.1), (1, 5.5, 5.5, 37999.1)]
    assert written and max(spark.read.parquet(p).count() for p in written) == 4002


def test_quantile_places_are_exact(spark):
    """0.07 * 100 is more than 7 in binary; the place is the seventh, as in SQL."""
    df = spark.range(1, 101).withColumn("v", F.col("id"))
    got = aggregates.quantiles(df, [], {f"q{k}": (F.col("v"), k / 100, False) for k in (0, 7, 14, 28, 55, 100)}).first().asDict()
    assert got == {"q0": 1, "q7": 7, "q14": 14, "q28": 28, "q55": 55, "q100": 100}


def test_rows_with_groups(spark, monkeypatch):
    """Beside every row stands its group's, also where the groups aren't broadcast and one holds most rows."""
    rows = spark.range(3000).selectExpr("IF(id < 2900, NULL, id % 7) AS k", "id AS v")
    groups = rows.groupBy("k").agg(F.max("v").alias("top")).filter("k IS NULL OR k > 0")
    for most in (aggregates.GROUPS, 0):
        monkeypatch.setattr(aggregates, "GROUPS", most)
        out = aggregates.with_groups(rows, ["k"], groups)
        got = {r.v: r.top for r in out.collect()}
        tops = {k: max(i for i in range(2900, 3000) if i % 7 == k) for k in range(1, 7)}
        assert out.count() == 3000 and got == {i: 2899 if i < 2900 else tops.get(i % 7) for i in range(3000)}
