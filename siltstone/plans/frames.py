"""Queries written with the DataFrame operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import relational as R
from ..operators import statistics as T
from ..operators import windows as W
from ..sources.tables import table

_Q = Callable[[SparkSession, str], DataFrame]
FRAMES: dict[str, tuple[_Q, str]] = {}


def query(sql: str):
    def add(f: _Q) -> _Q:
        FRAMES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n, CAST(MIN(l_quantity) AS DOUBLE) AS lo, ROUND(AVG(l_discount), 6) AS a FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag), (l_linenumber), ())")
def df_grouping_sets(spark, d):
    sets = [["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag"], ["l_linenumber"], []]
    out = R.grouping_sets(table(spark, d, "lineitem"), sets, {"n": ("count", "*"), "lo": ("min", "l_quantity"), "a": ("avg", "l_discount")})
    return out.withColumn("a", F.round("a", 6))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 2")
def df_top_k_by_group(spark, d):
    return R.top_k_by_group(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), 2, ["c_nationkey"], "-c_acctbal", "c_custkey")


@query("SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) t WHERE rn = 1")
def df_distinct_on(spark, d):
    return R.distinct_on(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "-ts", "event_id").select("user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders) t WHERE r <= 5")
def df_qualify(spark, d):
    w = W.ordered(["o_orderpriority"], "-o_totalprice")
    return R.qualify(table(spark, d, "orders"), F.rank().over(w), lambda r: r <= 5).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 5 AND c_acctbal < 6000)")
def df_compare_all(spark, d):
    others = table(spark, d, "customer").filter("c_nationkey = 5 and c_acctbal < 6000")
    return R.compare_all(table(spark, d, "supplier"), "s_acctbal", ">=", others, "c_acctbal").select("s_suppkey", "s_acctbal")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)")
def df_not_in(spark, d):
    return J.not_in(table(spark, d, "part"), "p_partkey", table(spark, d, "lineitem").filter("l_quantity > 47"), "l_partkey").select("p_partkey")


@query("SELECT c_custkey, COUNT(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def df_counting_left_join(spark, d):
    return J.counting_left_join(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "orders").select("c_custkey", "orders")


@query("SELECT p_brand, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount)), 1) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def df_aggregate_then_join(spark, d):
    sums = {"q": F.col("l_quantity"), "r": F.col("l_extendedprice") * (1 - F.col("l_discount"))}
    out = J.aggregate_then_join(table(spark, d, "lineitem"), "l_partkey", sums, table(spark, d, "part"), "p_partkey", ["p_brand"])
    return out.select("p_brand", F.round("q", 2).alias("q"), F.round("r", 1).alias("r"))


@query("SELECT MIN(s_name) AS s, MAX(p_name) AS p, COUNT(*) AS n FROM lineitem, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_size < 5 AND s_acctbal > 5000")
def df_star_reduced(spark, d):
    part, supplier = table(spark, d, "part").filter("p_size < 5"), table(spark, d, "supplier").filter("s_acctbal > 5000")
    fact = J.reduce_by(table(spark, d, "lineitem"), (part, "l_partkey", "p_partkey"), (supplier, "l_suppkey", "s_suppkey"))
    joined = J.join_all(fact, (part, fact.l_partkey == part.p_partkey), (supplier, fact.l_suppkey == supplier.s_suppkey))
    return joined.agg(F.min("s_name").alias("s"), F.max("p_name").alias("p"), F.count("*").alias("n"))


@query("SELECT a.event_id, b.band FROM events a JOIN (VALUES (1, 5.0, 9.5), (2, 8.0, 30.25)) b(band, low, high) ON a.value BETWEEN b.low AND b.high")
def df_range_join(spark, d):
    spans = spark.createDataFrame([(1, 5.0, 9.5), (2, 8.0, 30.25)], "band int, low double, high double")
    return J.range_join(table(spark, d, "events"), "value", spans, "low", "high", 4.0).select("event_id", "band")


@query("SELECT l_returnflag, " + ", ".join(f"CAST(SUM(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(20)) + " FROM lineitem GROUP BY l_returnflag")
def df_affine_sums(spark, d):
    return A.affine_sums(table(spark, d, "lineitem"), "l_linenumber", list(range(20)), ["l_returnflag"])


@query("SELECT event_type, COUNT(DISTINCT user_id) AS distinct_count FROM events GROUP BY event_type")
def df_group_distinct(spark, d):
    return A.distinct_count_by_group(table(spark, d, "events"), ["event_type"], "user_id")


@query("SELECT source, CAST(COUNT(*) AS BIGINT) AS n FROM documents GROUP BY source")
def df_salted_count(spark, d):
    return A.salted(table(spark, d, "documents").select("source", "doc_id"), ["source"], "n", 16, "doc_id")


@query("SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS total, COUNT(l_quantity) AS rows, ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def df_merge_partials(spark, d):
    whole = table(spark, d, "lineitem")
    out = A.merge_partials([whole.filter("l_orderkey % 2 = 0"), whole.filter("l_orderkey % 2 <> 0")], ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", F.round("total", 2).alias("total"), "rows", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS so_far, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS high, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts) AS peers FROM events")
def df_windows(spark, d):
    keys, order = ["user_id"], ("ts", "event_id")
    return table(spark, d, "events").select(
        "event_id",
        F.round(W.running_rows(F.sum("value"), keys, *order), 4).alias("so_far"),
        W.moving(F.max("value"), 4, keys, *order).alias("high"),
        W.running(F.count("*"), keys, "ts").alias("peers"),
    )


@query("SELECT event_id, CAST(SUM(late) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN EPOCH_US(ts) - LAG(EPOCH_US(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 7200000000 THEN 1 ELSE 0 END AS late FROM events) t")
def df_sessions(spark, d):
    return W.with_sessions(table(spark, d, "events"), "ts", 7200, ["user_id"], "event_id").select("event_id", "session")


@query("SELECT o_orderkey, DATE_DIFF('month', o_orderdate, TIMESTAMP '2000-03-01 00:00:00') AS m, EXTRACT(DOW FROM o_orderdate) AS dow, EXTRACT(ISODOW FROM o_orderdate) AS iso, STRFTIME(o_orderdate, '%d.%m.%Y') AS f, DATE_TRUNC('week', o_orderdate) AS t, EPOCH(o_orderdate) AS e FROM orders")
def df_dates(spark, d):
    end, at = F.lit("2000-03-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        S.date_diff("month", at, end).alias("m"),
        S.day_of_week(at).alias("dow"),
        S.iso_day_of_week(at).alias("iso"),
        S.strftime(at, "%d.%m.%Y").alias("f"),
        S.date_trunc("week", at).alias("t"),
        S.epoch(at).alias("e"),
    )


@query("SELECT p_partkey, REGEXP_REPLACE(p_name, '([a-zA-Z])(\\d)', '\\2\\1') AS first_only, REGEXP_REPLACE(p_name, '[aeiou]', '_', 'g') AS everywhere, p_size / NULLIF(p_size - 10, 0) AS q, CAST(p_size // NULLIF(p_size - 10, 0) AS BIGINT) AS i FROM part")
def df_scalars(spark, d):
    name, size = F.col("p_name"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        S.regexp_replace(name, r"([a-zA-Z])(\d)", r"\2\1").alias("first_only"),
        S.regexp_replace(name, "[aeiou]", "_", True).alias("everywhere"),
        S.divide(size, size - 10).alias("q"),
        S.int_divide(size, size - 10).alias("i"),
    )


@query("SELECT n_regionkey, STRING_AGG(DISTINCT CAST(n_nationkey % 4 AS VARCHAR), ',' ORDER BY CAST(n_nationkey % 4 AS VARCHAR)) AS ks, MIN(n_nationkey) AS m FROM nation GROUP BY n_regionkey")
def df_string_agg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(S.string_agg_distinct(F.col("n_nationkey") % 4).alias("ks"), F.min("n_nationkey").alias("m"))


@query("SELECT CAST(SUM(CAST(o_orderkey AS HUGEINT) * 100000000000) AS VARCHAR) AS s FROM orders")
def df_exact_sum(spark, d):
    return table(spark, d, "orders").agg(S.exact_sum(F.col("o_orderkey").cast("long") * 100000000000).cast("string").alias("s"))


@query("""SELECT * FROM (VALUES ('n_name', 'string', 25, 0), ('n_nationkey', 'int', 25, 0), ('n_regionkey', 'int', 25, 0)) v("column", "type", "rows", "nulls")""")
def df_column_statistics(spark, d):
    out = T.column_statistics(table(spark, d, "nation")).drop("least", "greatest", "distinct")
    return out.select("column", "type", *[F.col(c).cast("int").alias(c) for c in ("rows", "nulls")])


@query("SELECT c_custkey, ROUND(c_acctbal / NULLIF(SUM(c_acctbal) OVER (PARTITION BY c_nationkey), 0), 6) AS part FROM customer")
def df_share(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(W.share("c_acctbal", ["c_nationkey"]), 6).alias("part"))


@query("SELECT n_name AS name FROM nation INTERSECT ALL SELECT n_name FROM nation WHERE n_nationkey < 9 UNION ALL SELECT r_name FROM region")
def df_set_operations(spark, d):
    nation = table(spark, d, "nation")
    few = nation.select(F.col("n_name").alias("name")).intersectAll(nation.filter("n_nationkey < 9").select("n_name"))
    return R.union_all(few, table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 5")
def df_top_k(spark, d):
    return R.top_k(table(spark, d, "part").select("p_partkey", "p_retailprice"), 15, "-p_retailprice", "p_partkey", offset=5)


@query("SELECT event_type, date_trunc('day', ts) AS day, COUNT(*) AS n, ROUND(SUM(value), 3) AS v FROM events GROUP BY 1, 2")
def df_daily_rollup(spark, d):
    return table(spark, d, "events").groupBy("event_type", S.date_trunc("day", F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("v"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice - LAG(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS step FROM orders")
def df_lag_step(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("step"))
