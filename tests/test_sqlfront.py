import duckdb
import pytest

from siltstone import plans
from siltstone.functions import semantics, sqlfront

from .compare import assert_same, connect

SAME = [
    r"SELECT 'a\b' AS a, 'it''s' AS b, '\d+' AS c",
    r"SELECT x FROM (VALUES ('a%b'), ('a\b'), ('ab')) v(x) WHERE x LIKE 'a\%'",
    "SELECT REGEXP_REPLACE('aXbXc', 'X', '-') AS a, REGEXP_REPLACE('aXbXc', 'X', '-', 'g') AS b, REGEXP_REPLACE('k=v', '(\\w)=(\\w)', '\\2=\\1') AS c",
    "SELECT REGEXP_MATCHES('hello', 'l+o$') AS a, LOG(100) AS b, STRLEN('äö') AS c, LENGTH('äö') AS d",
    "SELECT a FROM (VALUES (1), (NULL), (2)) v(a) ORDER BY a LIMIT 2",
    "SELECT a FROM (VALUES (1), (NULL), (2)) v(a) ORDER BY a DESC LIMIT 2",
    "SELECT a FROM (VALUES (1), (5)) v(a) WHERE a > ALL (SELECT 9 WHERE 1 = 0)",
    "SELECT a FROM (VALUES (1), (5)) v(a) WHERE a > ALL (SELECT x FROM (VALUES (2), (NULL)) w(x))",
    "SELECT a FROM (VALUES (1), (5)) v(a) WHERE a > ANY (SELECT x FROM (VALUES (2), (NULL)) w(x))",
    "SELECT a FROM (VALUES (1), (5)) v(a) WHERE NOT (a <> ALL (SELECT x FROM (VALUES (1), (NULL)) w(x)))",
    "SELECT STRFTIME(TIMESTAMP '2024-03-09 07:05:01', '%Y/%m/%d at %H:%M:%S') AS f, DATE_DIFF('month', DATE '2024-01-31', DATE '2024-02-01') AS m",
    "SELECT CAST(DATE '2024-01-31' + INTERVAL 1 MONTH AS TIMESTAMP) AS a, TIMESTAMP '2024-02-29 10:00:00' - INTERVAL 1 YEAR AS b",
    "SELECT 7 / 2 AS a, -7 % 3 AS b, CAST(-7 // 2 AS BIGINT) AS c, ROUND(2.5) AS d, ROUND(-2.5) AS e",
    'SELECT a AS "select me" FROM (VALUES (1)) v(a) -- a comment\n',
    "SELECT STRING_AGG(DISTINCT CAST(a AS VARCHAR), '-' ORDER BY CAST(a AS VARCHAR)) AS s FROM (VALUES (10), (9), (10)) v(a)",
    "WITH RECURSIVE r(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r",
    "SELECT a, COUNT(*) AS n FROM (VALUES (1), (1), (NULL)) v(a) GROUP BY ALL",
    "SELECT SUM(a) FILTER (WHERE a > 1) AS s, BOOL_AND(a > 0) AS b FROM (VALUES (1), (2), (3)) v(a)",
    "SELECT CASE WHEN a > 1 THEN 'x' END AS c, COALESCE(NULL, a) AS d, NULLIF(a, 1) AS e FROM (VALUES (1), (2)) v(a)",
]


@pytest.mark.parametrize("sql", SAME)
def test_same_as_oracle(spark, sql):
    assert_same(spark.sql(sqlfront.translate(sql)), duckdb.sql(sql))


def test_division_by_zero_is_null(spark):
    row = spark.sql(sqlfront.translate("SELECT 1 / a AS x, 1 // a AS y, 1 % a AS z, 1 / SUM(a) OVER () AS w FROM (VALUES (0)) v(a)")).first()
    assert tuple(row) == (None, None, None, None)


def test_ranks_filter_before_the_shuffle(spark, sf):
    sql = "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2"
    df = spark.sql(sqlfront.with_tables(sql, {"orders": f"{sf}/orders.parquet"}))
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


def test_pushdown_reaches_the_scan(spark, sf):
    sql = "SELECT SUM(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'"
    plan = spark.sql(sqlfront.with_tables(sql, {"lineitem": f"{sf}/lineitem.parquet"}))._jdf.queryExecution().toString()
    assert "GreaterThan(l_discount,0.05)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in plan


def test_distinct_values_in_the_order_of_the_value_before_its_cast(spark):
    row = spark.sql(sqlfront.translate("SELECT STRING_AGG(DISTINCT CAST(a AS VARCHAR), '-' ORDER BY a) AS s FROM (VALUES (10), (9), (10)) v(a)")).first()
    assert row.s == "9-10"


def test_errors():
    with pytest.raises(ValueError):
        sqlfront.translate("SELECT (1")
    with pytest.raises(ValueError):
        sqlfront.translate("SELECT 1)")
    with pytest.raises(ValueError):
        semantics.date_pattern("%Q")


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_plans_for_large_tables(spark, sf):
    """No window over all rows in one task, and no join by broadcasting whatever NOT IN reads."""
    for name in ("win_ntile", "win_ntile_few", "win_filtered", "win_totals", "win_whole_filtered"):
        assert "Window" not in plan_of(plans.QUERIES[name](spark, sf)) or name == "win_totals", name
        assert "windowspecdefinition(specifiedwindowframe" not in plan_of(plans.QUERIES[name](spark, sf)), name
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("anti_not_in", "anti_not_all", "tpch_q16"):
            if name in plans.QUERIES:
                assert "BroadcastHashJoin" not in plan_of(plans.QUERIES[name](spark, sf)) and "BroadcastNestedLoopJoin" not in plan_of(plans.QUERIES[name](spark, sf)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbers_in_order(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import windows

    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 40).alias("a"), F.col("id").alias("b"))
    out, total = windows.numbered(df, [F.col("a").desc(), F.col("b").asc()], "rn")
    want = sorted(((i % 40, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert total == 5000 and [(r.a, r.b) for r in sorted(out.collect(), key=lambda r: r.rn)] == want
    assert sorted(r.rn for r in out.collect()) == list(range(1, 5001))
    assert windows.numbered(df.limit(0), [F.col("a")], "rn")[0].count() == 0


def test_quantiles_in_ranges(spark, sf, monkeypatch):
    """Beyond a size no state holds a group's values, with equal results."""
    con = connect(sf)
    monkeypatch.setattr(sqlfront, "PERCENTILE_BYTES", 0)
    for sql in (
        plans.ORACLE_SQL["agg_median"],
        plans.ORACLE_SQL["agg_quantile"],
        plans.ORACLE_SQL["h2o_group_q6"],
        "SELECT MEDIAN(o_totalprice) AS m, COUNT(*) AS n FROM orders WHERE o_orderkey < 0",
        "SELECT l_returnflag, MEDIAN(NULLIF(l_linenumber, 3)) AS m, QUANTILE_DISC(l_quantity, 0.25) AS q FROM lineitem GROUP BY l_returnflag HAVING MEDIAN(l_quantity) > 3 ORDER BY m, l_returnflag",
        "SELECT k, MEDIAN(v) AS m, QUANTILE_DISC(v, 0) AS a, QUANTILE_DISC(v, 1) AS z FROM t GROUP BY k",
    ):
        if " t " in sql:
            spark.createDataFrame([(1, 2.0), (1, None), (None, 5.0), (None, 7.0), (3, None)], "k int, v double").createOrReplaceTempView("t")
            con.sql("CREATE TEMP TABLE t AS SELECT * FROM (VALUES (1, 2.0::DOUBLE), (1, NULL), (NULL, 5.0), (NULL, 7.0), (3, NULL)) v(k, v)")
            df = sqlfront.run(spark, sql)
        else:
            df = plans.run_sql(spark, sf, sql)
        assert "percentile" not in plan_of(df).lower()
        assert_same(df, con.sql(sql))


def test_quantiles_by_counted_rows(spark):
    """Files may be far smaller than what a percentile's state holds, so the estimate of bytes alone doesn't decide."""
    con = duckdb.connect()
    spark.range(1_200_000).selectExpr("id % 3 AS k", "id * 7 % 1200000 AS v").createOrReplaceTempView("t")
    con.sql("CREATE TABLE t AS SELECT range % 3 AS k, range * 7 % 1200000 AS v FROM range(1200000)")
    for sql in ("SELECT QUANTILE_CONT(v, 0.9) AS a, QUANTILE_DISC(v, 0.25) AS b FROM t", "SELECT K AS k, COUNT(*) AS n, MEDIAN(v) AS m FROM t GROUP BY K"):
        df = sqlfront.run(spark, sql)
        assert "percentile" not in plan_of(df).lower()
        assert_same(df, con.sql(sql))


def test_quantile_places(spark, monkeypatch):
    """0.07 * 100 is more than 7 in binary; both ways take the seventh value."""
    con = duckdb.connect()
    spark.range(1, 101).createOrReplaceTempView("t")
    con.sql("CREATE TABLE t AS SELECT range AS id FROM range(1, 101)")
    sql = f"SELECT {', '.join(f'QUANTILE_DISC(id, {p}) AS d{k}, QUANTILE_CONT(id, {p}) AS c{k}' for k, p in enumerate([0, 0.07, 0.14, 0.28, 0.55, 0.555, 1]))} FROM t"
    for most in (sqlfront.PERCENTILE_BYTES, 0):
        monkeypatch.setattr(sqlfront, "PERCENTILE_BYTES", most)
        assert_same(sqlfront.run(spark, sql), con.sql(sql))
