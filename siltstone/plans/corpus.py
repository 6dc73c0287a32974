"""Queries as SQL text, in the dialect that siltstone.functions.sqlfront translates; the same text runs in DuckDB.

have one width on both sides, and sums of doubles are rounded, as their last digits depend on the order of addition.
"""

from __future__ import annotations

_Q1 = """
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc,
       COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
"""

TPCH = {
    "tpch_q1": _Q1,
    "tpch_q3": """
        SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q4": """
        SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
        WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-07-01 00:00:00' + INTERVAL 3 MONTH
          AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q5": """
        SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
          AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey <= 2
          AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'
        GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "tpch_q6": """
        SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
          AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": """
        SELECT supp_nation, cust_nation, l_year, ROUND(SUM(volume), 2) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, EXTRACT(YEAR FROM l_shipdate) AS l_year,
                   l_extendedprice * (1 - l_discount) AS volume
            FROM supplier, lineitem, orders, customer, nation n1, nation n2
            WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
              AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
              AND ((n1.n_nationkey = 6 AND n2.n_nationkey = 7) OR (n1.n_nationkey = 7 AND n2.n_nationkey = 6))) AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q10": """
        SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 1) AS revenue, c_acctbal, n_name
        FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
          AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": """
        SELECT l_partkey, ROUND(SUM(l_extendedprice), 2) AS value FROM lineitem GROUP BY l_partkey
        HAVING SUM(l_extendedprice) > (SELECT SUM(l_extendedprice) * 0.0007 FROM lineitem) ORDER BY value DESC, l_partkey""",
    "tpch_q12": """
        SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS high_count,
               CAST(SUM(CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS low_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_returnflag IN ('A', 'N') AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
        GROUP BY l_linestatus ORDER BY l_linestatus""",
    "tpch_q13": """
        SELECT c_count, COUNT(*) AS custdist FROM (
            SELECT c_custkey, COUNT(o_orderkey) AS c_count
            FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
            GROUP BY c_custkey) AS c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": """
        SELECT ROUND(100.00 * SUM(CASE WHEN p_type LIKE 'P%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
               / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01 00:00:00'
          AND l_shipdate < TIMESTAMP '1997-09-01 00:00:00' + INTERVAL 1 MONTH""",
    "tpch_q17": """
        SELECT ROUND(SUM(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_size <= 10
          AND l_quantity < (SELECT 0.5 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, ROUND(SUM(l_quantity), 2) AS sum_qty
        FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200)
          AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
        ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": """
        SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#13' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#14' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)""",
    "tpch_q21": """
        SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem l1, orders
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        GROUP BY s_name ORDER BY numwait DESC, s_name""",
    "tpch_q22": """
        SELECT nationkey, COUNT(*) AS numcust, ROUND(SUM(acctbal), 2) AS totacctbal FROM (
            SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
            WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13)
              AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13))
              AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) AS custsale
        GROUP BY nationkey ORDER BY nationkey""",
}

PROJECTION = {
    "scan_star": "SELECT * FROM nation",
    "project_alias": "SELECT n_name AS name, n_nationkey AS k FROM nation",
    "project_expr": "SELECT o_orderkey, o_totalprice * 2 + 1 AS twice, -o_totalprice AS neg, 7 AS seven, 'x' AS tag FROM orders",
    "literal_select": "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, 7 / 2 AS q, CAST(7 // 2 AS BIGINT) AS d, 7 % 3 AS m",
    "values_source": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v(a, b) WHERE a > 1",
    "filter_compare": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000 AND o_orderkey <> 5 AND o_custkey < 700",
    "filter_columns": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < l_linenumber",
    "filter_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice NOT BETWEEN 1000 AND 1500",
    "filter_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, -3) OR s_suppkey NOT IN (1, 2, 3)",
    "filter_in_dates": "SELECT o_orderkey FROM orders WHERE o_orderdate IN (TIMESTAMP '1996-01-02 00:00:00', TIMESTAMP '1997-05-06 00:00:00')",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%l_e b%' AND p_type NOT LIKE 'S%' AND p_brand ILIKE 'BRAND#1_'",
    "filter_regexp": "SELECT page_id FROM pages WHERE REGEXP_MATCHES(url, 'example\\.(com|org)/(en|fr)')",
    "filter_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL",
    "filter_not_3vl": "SELECT a FROM (VALUES (1), (2), (NULL)) v(a) WHERE NOT (a = 1)",
    "filter_or": "SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND NOT (value > 50) AND user_id < 20",
    "filter_boolean": "SELECT k FROM (SELECT n_nationkey AS k, n_regionkey = 1 AS b FROM nation) t WHERE b",
    "filter_function": "SELECT doc_id FROM documents WHERE LENGTH(text) > 5000 AND UPPER(lang) = 'EN'",
    "filter_like_escape": "SELECT n_name, n_name LIKE 'NATION!_1%' ESCAPE '!' AS a, 'a%b' LIKE 'a\\%b' ESCAPE '\\' AS b FROM nation",
    "int_divide_double": "SELECT o_orderkey, o_totalprice // 1000 AS q FROM orders WHERE o_totalprice > 0",
    "date_minus_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS days FROM orders",
    "substr_from_zero": "SELECT SUBSTR(n_name, 0, 3) AS s FROM nation",
    "filter_count": "SELECT COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05 AND l_quantity <= 10",
    "count_complement": "SELECT COUNT(*) AS n FROM events WHERE event_type <> 'click'",
    "echo_rows": "SELECT event_type FROM events WHERE event_type = 'signup'",
    "compare_all": "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 7000)",
    "compare_all_empty": "SELECT r_regionkey FROM region WHERE r_regionkey > ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)",
    "compare_any": "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3)",
    "compare_eq_any": "SELECT n_name FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 2)",
    "qualify_topk": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "qualify_hidden_order": "SELECT o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 7",
    "distinct_on_hidden_order": "SELECT DISTINCT ON (o_custkey) o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 25",
    "qualify_alias": "SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS r FROM customer WHERE c_acctbal > 0 QUALIFY r = 1",
}

JOINS = {
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_chain": "SELECT r_name, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_pair_key": "SELECT COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_partkey < b.l_partkey",
    "join_rows_limit": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 25",
    "join_left_agg": "SELECT c_mktsegment, COUNT(*) AS n, COUNT(o_orderkey) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_mktsegment",
    "join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_full": "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY s_nationkey) b ON a.k = b.k",
    "join_cross": "SELECT r_name, n_nationkey FROM region CROSS JOIN nation WHERE n_nationkey < 4",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey",
    "join_self_shift": "SELECT COUNT(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1 WHERE a.o_custkey > b.o_custkey",
    "join_using": "SELECT COUNT(*) AS n FROM (SELECT l_orderkey AS k, l_linenumber AS j FROM lineitem WHERE l_returnflag = 'A') a JOIN (SELECT l_orderkey AS k, l_linenumber AS j FROM lineitem WHERE l_returnflag = 'N') b USING (k, j)",
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "anti_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "anti_not_all": "SELECT s_suppkey FROM supplier WHERE s_nationkey <> ALL (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND s_acctbal > 0",
    "anti_not_in_or": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region WHERE r_regionkey > 2) OR n_regionkey = 1",
    "anti_not_in_null_left": "SELECT k FROM (SELECT NULLIF(n_nationkey, 9) AS k FROM nation) t WHERE k NOT IN (SELECT r_regionkey FROM region)",
    "anti_not_in_empty": "SELECT k FROM (SELECT NULLIF(n_nationkey, 9) AS k FROM nation) t WHERE k NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99)",
    "anti_not_in_null": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region)",
    "exists_correlated": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09 AND l_quantity > 49)",
    "not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000)",
    "exists_differing": "SELECT COUNT(*) AS n FROM lineitem l1 WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey AND l2.l_returnflag = l1.l_returnflag)",
    "star_min_max": "SELECT MIN(p_name) AS p, MAX(s_name) AS s, MIN(c_name) AS c FROM lineitem, part, supplier, orders, customer WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND p_size = 15 AND o_orderpriority LIKE '1%'",
    "star_count": "SELECT COUNT(*) AS n, ROUND(AVG(l_quantity), 4) AS a FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = 1",
    "join_dimension": "SELECT p_brand, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "join_order_limit": "SELECT l_orderkey, l_partkey, l_extendedprice, p_name FROM lineitem JOIN part ON l_partkey = p_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, p_name LIMIT 20",
}

SUBQUERIES = {
    "scalar_where": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.8 * AVG(o_totalprice) FROM orders)",
    "scalar_where_empty": "SELECT n_name FROM nation WHERE n_nationkey > (SELECT MAX(r_regionkey) FROM region WHERE r_regionkey < 0)",
    "scalar_select": "SELECT r_name, (SELECT COUNT(*) FROM nation) AS nations FROM region",
    "scalar_join_having": "SELECT c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) GROUP BY c_mktsegment HAVING COUNT(*) > (SELECT COUNT(*) / 10 FROM orders)",
    "scalar_correlated": "SELECT o_orderkey FROM orders a WHERE o_totalprice > (SELECT 1.5 * AVG(b.o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)",
    "scalar_correlated_two": "SELECT COUNT(*) AS n FROM lineitem a WHERE l_quantity > (SELECT 1.2 * AVG(b.l_quantity) FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_returnflag = a.l_returnflag)",
    "in_having": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) >= 10)",
    "cte_chain": "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS m FROM a GROUP BY n) SELECT n, m FROM b WHERE m > 10",
    "cte_twice": "WITH t AS (SELECT c_nationkey AS k, ROUND(SUM(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey) SELECT a.k, a.s FROM t a WHERE a.s >= (SELECT MAX(b.s) / 2 FROM t b)",
    "cte_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 9) SELECT n, f FROM r",
    "from_subquery": "SELECT k, n FROM (SELECT l_suppkey AS k, COUNT(*) AS n FROM lineitem WHERE l_tax > 0.02 GROUP BY l_suppkey) t WHERE n > 400",
}

AGGREGATES = {
    "agg_count": "SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, COUNT(NULLIF(o_orderstatus, 'F')) AS not_f FROM orders",
    "agg_distinct": "SELECT COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_returnflag) AS f, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS d, AVG(DISTINCT l_linenumber) AS a FROM lineitem",
    "agg_distinct_grouped": "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS p, COUNT(*) AS n, MIN(DISTINCT l_linenumber) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_sum_exact": "SELECT CAST(SUM(x) AS VARCHAR) AS s, CAST(MAX(x) AS VARCHAR) AS m FROM (SELECT CAST(4611686018427387904 AS HUGEINT) + o_orderkey AS x FROM orders) t",
    "agg_min_max": "SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi, MIN(o_orderpriority) AS p, MAX(o_totalprice) AS t FROM orders",
    "agg_case": "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS big, ROUND(AVG(CASE WHEN o_custkey < 500 THEN o_totalprice END), 3) AS a FROM orders GROUP BY o_orderstatus",
    "agg_arithmetic": "SELECT l_linestatus, ROUND(100 * SUM(l_discount) / SUM(l_quantity), 6) AS pct, MAX(l_quantity) - MIN(l_quantity) AS spread FROM lineitem GROUP BY l_linestatus",
    "agg_stddev": "SELECT ROUND(STDDEV(l_quantity), 6) AS a, ROUND(STDDEV_POP(l_quantity), 6) AS b, ROUND(VARIANCE(l_quantity), 6) AS c, ROUND(VAR_POP(l_quantity), 6) AS d, ROUND(CORR(l_quantity, l_extendedprice), 6) AS e FROM lineitem",
    "agg_median": "SELECT l_returnflag, ROUND(MEDIAN(l_extendedprice), 4) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_quantile": "SELECT ROUND(QUANTILE_CONT(o_totalprice, 0.9), 4) AS q90, ROUND(QUANTILE_CONT(o_totalprice, 0.25), 4) AS q25, CAST(QUANTILE_DISC(o_orderkey, 0.5) AS BIGINT) AS d FROM orders",
    "agg_mode": "SELECT k % 3 AS g, MODE(CASE WHEN k % 7 < 4 THEN 'most' WHEN k % 7 < 6 THEN 'some' ELSE n END) AS m FROM (SELECT c_custkey AS k, c_name AS n FROM customer) t GROUP BY k % 3",
    "agg_bool": "SELECT n_regionkey, BOOL_AND(n_nationkey > 2) AS a, BOOL_OR(n_nationkey > 20) AS o FROM nation GROUP BY n_regionkey",
    "agg_any_value": "SELECT r_regionkey, ANY_VALUE(r_name) AS v FROM region GROUP BY r_regionkey",
    "agg_string": "SELECT n_regionkey, STRING_AGG(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "agg_string_distinct": "SELECT o_orderstatus, STRING_AGG(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT COUNT(*) FILTER (WHERE l_returnflag = 'R') AS r, ROUND(SUM(l_quantity) FILTER (WHERE l_linenumber = 1), 2) AS q FROM lineitem",
    "agg_empty": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderpriority) AS m FROM orders WHERE o_orderkey < 0",
    "group_null_key": "SELECT k, COUNT(*) AS n FROM (SELECT NULLIF(l_linenumber, 3) AS k FROM lineitem) t GROUP BY k",
    "group_alias": "SELECT l_linenumber % 3 AS g, COUNT(*) AS n FROM lineitem GROUP BY g",
    "group_position": "SELECT event_type, user_id, COUNT(*) AS n FROM events GROUP BY 1, 2",
    "group_all": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL",
    "group_extract": "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY y, m",
    "group_trunc": "SELECT DATE_TRUNC('month', l_shipdate) AS m, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY 1",
    "group_scalar_fn": "SELECT LENGTH(p_name) AS n, LOWER(p_type) AS t, COUNT(*) AS c FROM part GROUP BY LENGTH(p_name), LOWER(p_type)",
    "group_regexp": "SELECT REGEXP_REPLACE(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS host, AVG(LENGTH(url)) AS l, COUNT(*) AS c, MIN(url) AS m FROM pages GROUP BY 1",
    "group_affine": "SELECT l_linenumber AS a, l_linenumber - 1 AS b, l_linenumber - 2 AS c, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber, l_linenumber - 1, l_linenumber - 2",
    "group_case": "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS band, COUNT(*) AS n FROM lineitem GROUP BY 1",
    "group_constant": "SELECT 1 AS one, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1, l_returnflag",
    "group_having": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND (AVG(o_totalprice) > 200000 OR MIN(o_totalprice) < 2000)",
    "group_function_of_key": "SELECT p_type, LENGTH(p_type) AS n, COUNT(*) AS c FROM part GROUP BY p_type",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "group_rollup": "SELECT o_orderstatus, o_orderpriority, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "group_cube": "SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "affine_sums": "SELECT " + ", ".join(f"CAST(SUM(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(30)) + " FROM lineitem",
    "whole_multi": "SELECT ROUND(SUM(l_quantity), 2) AS s, COUNT(*) AS n, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem",
    "top_count": "SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    "top_count_filtered": "SELECT user_id, COUNT(*) AS c FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING COUNT(*) > 2 ORDER BY c DESC, user_id LIMIT 10",
    "top_pair": "SELECT user_id, event_type, COUNT(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10",
    "top_pair_sums": "SELECT l_suppkey, l_linenumber, COUNT(*) AS c, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_discount), 6) AS a FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_suppkey, l_linenumber ORDER BY c DESC, l_suppkey, l_linenumber LIMIT 10",
    "top_pair_offset": "SELECT l_partkey, l_suppkey, COUNT(*) AS c FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-07-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-07-01 00:00:00' GROUP BY l_partkey, l_suppkey ORDER BY c DESC, l_partkey, l_suppkey LIMIT 10 OFFSET 100",
    "top_triple_minute": "SELECT user_id, EXTRACT(MINUTE FROM ts) AS m, event_type, COUNT(*) AS c FROM events GROUP BY user_id, m, event_type ORDER BY c DESC, user_id, m, event_type LIMIT 10",
    "top_mix": "SELECT l_suppkey, ROUND(SUM(l_quantity), 2) AS s, COUNT(*) AS c, ROUND(AVG(l_extendedprice), 4) AS a, COUNT(DISTINCT l_partkey) AS d FROM lineitem GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10",
    "top_distinct_users": "SELECT event_type, EXTRACT(HOUR FROM ts) AS h, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type, h ORDER BY u DESC, event_type, h LIMIT 10",
    "top_sum": "SELECT l_orderkey, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_orderkey ORDER BY s DESC, l_orderkey LIMIT 10",
    "distinct_hour_key": "SELECT DISTINCT EXTRACT(HOUR FROM ts) AS h, user_id FROM events ORDER BY h, user_id LIMIT 50",
    "text_length_having": "SELECT source, ROUND(AVG(STRLEN(text)), 4) AS l, COUNT(*) AS c FROM documents WHERE text <> '' GROUP BY source HAVING COUNT(*) > 10 ORDER BY l DESC, source LIMIT 25",
    "h2o_range": "SELECT l_suppkey, MAX(l_quantity) - MIN(l_linenumber) AS r FROM lineitem GROUP BY l_suppkey",
    "h2o_top2": "SELECT l_suppkey, l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem) t WHERE rn <= 2",
    "h2o_corr2": "SELECT l_returnflag, l_linestatus, ROUND(POWER(CORR(l_quantity, l_discount), 2), 8) AS r2 FROM lineitem GROUP BY l_returnflag, l_linestatus",
}

WINDOWS = {
    "win_row_number": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT l_orderkey, l_linenumber, l_partkey, RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, DENSE_RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS d FROM lineitem",
    "win_ntile": "SELECT c_custkey, NTILE(7) OVER (ORDER BY c_acctbal, c_custkey) AS t FROM customer",
    "win_ntile_few": "SELECT n_name, NTILE(40) OVER (ORDER BY n_name DESC) AS t, ROW_NUMBER() OVER (ORDER BY n_name DESC) AS r FROM nation WHERE n_nationkey > 3",
    "win_whole_filtered": "SELECT o_orderkey, COUNT(*) OVER () AS n, ROUND(o_totalprice / SUM(o_totalprice) OVER () * 1000, 6) AS part FROM orders WHERE o_orderstatus = 'F'",
    "win_lag_lead": "SELECT event_id, LAG(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, LEAD(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events",
    "win_first_value": "SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders",
    "win_totals": "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n, ROUND(SUM(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS s, MAX(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m, ROUND(AVG(c_acctbal) OVER (), 6) AS a FROM customer",
    "win_running_peers": "SELECT l_orderkey, l_linenumber, l_partkey, COUNT(*) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS n, MIN(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS m FROM lineitem",
    "win_rows_unbounded": "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS s FROM events",
    "win_rows_k": "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS a, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM events",
    "win_filtered": "SELECT event_id, ROW_NUMBER() OVER (ORDER BY user_id, ts, event_id) AS rn FROM events WHERE event_type = 'purchase'",
    "win_arithmetic": "SELECT o_orderkey, ROUND(100 * o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS pct FROM orders",
    "win_topk": "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3",
    "win_following": "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS s, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM events",
}

ORDER_AND_SETS = {
    "order_multi": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_linenumber DESC, l_orderkey, l_partkey LIMIT 30",
    "order_expression": "SELECT o_orderkey FROM orders ORDER BY o_totalprice - o_custkey DESC, o_orderkey LIMIT 15",
    "order_hidden": "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12",
    "order_nulls": "SELECT a FROM (VALUES (3), (NULL), (1)) v(a) ORDER BY a DESC LIMIT 2",
    "limit_offset": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 37",
    "order_group_topk": "SELECT l_partkey, COUNT(*) AS n, MAX(l_shipdate) AS last FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT 99",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48",
    "set_order_limit": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region ORDER BY name LIMIT 7 OFFSET 2",
}

SCALARS = {
    "fn_math": "SELECT s_suppkey, ROUND(s_acctbal / 7, 3) AS r, CAST(FLOOR(s_acctbal) AS BIGINT) AS f, CAST(CEIL(s_acctbal) AS BIGINT) AS c, ABS(s_acctbal) AS a, ROUND(SQRT(ABS(s_acctbal)), 6) AS q, ROUND(LN(s_suppkey + 1), 8) AS n, ROUND(LOG(s_suppkey + 1), 8) AS l, ROUND(LOG(2, s_suppkey + 1), 8) AS b, ROUND(POWER(s_suppkey, 1.5), 4) AS p FROM supplier",
    "fn_conditional": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.05 THEN 'high' WHEN l_tax > 0.02 THEN 'mid' END AS t, COALESCE(NULLIF(l_linenumber, 2), -1) AS n FROM lineitem WHERE l_orderkey < 300",
    "fn_string": "SELECT n_nationkey, LENGTH(n_name) AS l, STRLEN(n_name) AS b, UPPER(n_name) AS u, LOWER(n_name) AS w, TRIM('  ' || n_name || ' ') AS t, SUBSTRING(n_name, 2, 3) AS s, REPLACE(n_name, 'A', 'aa') AS r, n_name || '-' || n_regionkey AS c, CONCAT(n_name, NULL, '!') AS x FROM nation",
    "fn_bytes": "SELECT doc_id, LENGTH(text) AS chars, STRLEN(text) AS bytes FROM documents",
    "fn_regexp_first": "SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '#') AS first_only, REGEXP_REPLACE(p_name, '[aeiou]', '#', 'g') AS everywhere, REGEXP_REPLACE(p_name, '([A-Za-z]+)', '<\\1>') AS grouped FROM part",
    "fn_predicates": "SELECT k, k IS NULL AS a, (k > 2) IS TRUE AS b, k IN (1, 2) AS c, k BETWEEN 2 AND 3 AS d FROM (VALUES (1), (2), (3), (NULL)) v(k)",
    "fn_cast": "SELECT CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS VARCHAR) AS v, CAST(p_size AS BIGINT) AS b, CAST('2020-02-29' AS DATE) AS e FROM part",
    "date_parts": "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(QUARTER FROM ts) AS q, EXTRACT(MONTH FROM ts) AS mo, EXTRACT(DAY FROM ts) AS d, EXTRACT(DOW FROM ts) AS dow, EXTRACT(ISODOW FROM ts) AS iso, EXTRACT(DOY FROM ts) AS doy, EXTRACT(WEEK FROM ts) AS w, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s FROM events",
    "date_part_calls": "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAYOFYEAR(o_orderdate) AS d, DATE_PART('quarter', o_orderdate) AS q FROM orders",
    "date_trunc_all": "SELECT event_id, DATE_TRUNC('year', ts) AS y, DATE_TRUNC('quarter', ts) AS q, DATE_TRUNC('week', ts) AS w, DATE_TRUNC('day', ts) AS d, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('minute', ts) AS m, DATE_TRUNC('second', ts) AS s FROM events",
    "date_interval": "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS a, o_orderdate - INTERVAL 1 MONTH AS b, o_orderdate + INTERVAL 2 YEAR AS c, o_orderdate + INTERVAL 5 HOUR AS d, o_orderdate + INTERVAL 2 WEEK AS e FROM orders",
    "date_diff_units": "SELECT l_orderkey, l_linenumber, l_partkey, DATE_DIFF('day', o_orderdate, l_shipdate) AS d, DATE_DIFF('month', o_orderdate, l_shipdate) AS m, DATE_DIFF('year', o_orderdate, l_shipdate) AS y, DATE_DIFF('hour', o_orderdate, l_shipdate) AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "date_last_day": "SELECT o_orderkey, LAST_DAY(o_orderdate) AS l FROM orders",
    "date_strftime": "SELECT event_id, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS f, STRFTIME(ts, '%d/%m/%y T%H') AS g FROM events",
    "date_epoch": "SELECT event_id, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS e FROM events",
    "date_filter": "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-02-01' AND o_orderdate < DATE '1997-02-01' + INTERVAL 1 MONTH AND EXTRACT(DOW FROM o_orderdate) IN (0, 6)",
    "division_by_zero": "SELECT k, 10 / NULLIF(k, 0) AS q, CAST(10 // NULLIF(k, 0) AS BIGINT) AS d, 10 % NULLIF(k, 0) AS m FROM (VALUES (0), (3), (-4)) v(k)",
}

H2O = {
    "h2o_group_q1": "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS v1 FROM lineitem GROUP BY l_returnflag",
    "h2o_group_q2": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS v1 FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "h2o_group_q3": "SELECT l_partkey, ROUND(SUM(l_quantity), 2) AS v1, ROUND(AVG(l_extendedprice), 6) AS v3 FROM lineitem GROUP BY l_partkey",
    "h2o_group_q4": "SELECT l_linenumber, ROUND(AVG(l_quantity), 6) AS v1, ROUND(AVG(l_discount), 6) AS v2, ROUND(AVG(l_extendedprice), 4) AS v3 FROM lineitem GROUP BY l_linenumber",
    "h2o_group_q5": "SELECT l_suppkey, ROUND(SUM(l_quantity), 2) AS v1, ROUND(SUM(l_tax), 4) AS v2, ROUND(SUM(l_extendedprice), 2) AS v3 FROM lineitem GROUP BY l_suppkey",
    "h2o_group_q6": "SELECT l_linenumber, l_suppkey, MEDIAN(l_quantity) AS m, ROUND(STDDEV(l_extendedprice), 4) AS s FROM lineitem WHERE l_suppkey < 40 GROUP BY l_linenumber, l_suppkey",
    "h2o_group_q7": "SELECT l_partkey, MAX(l_quantity) - MIN(l_linenumber) AS r FROM lineitem GROUP BY l_partkey",
    "h2o_group_q10": "SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_partkey, ROUND(SUM(l_extendedprice), 2) AS v3, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_partkey",
    "h2o_join_small": "SELECT ROUND(SUM(l_quantity), 2) AS v1, ROUND(SUM(s_acctbal), 2) AS v2, COUNT(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "h2o_join_medium": "SELECT ROUND(SUM(l_quantity), 2) AS v1, ROUND(SUM(p_retailprice), 1) AS v2, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey",
    "h2o_join_left": "SELECT COUNT(*) AS n, COUNT(p_partkey) AS m FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 20) p ON l_partkey = p_partkey",
    "h2o_join_big": "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 0) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}

#: Star joins that return least and greatest strings.
JOB = {
    "job_brand_region": "SELECT MIN(p_name) AS part_name, MIN(n_name) AS nation, MAX(o_orderpriority) AS priority FROM lineitem, part, orders, customer, nation, region WHERE l_partkey = p_partkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 2 AND p_brand IN ('Brand#3', 'Brand#11') AND o_orderstatus = 'O'",
    "job_supplier_names": "SELECT MIN(s_name) AS first_supplier, MAX(s_name) AS last_supplier FROM supplier, nation, lineitem WHERE s_nationkey = n_nationkey AND l_suppkey = s_suppkey AND n_regionkey <> 1 AND l_discount > 0.09 AND s_acctbal BETWEEN 0 AND 4000",
    "job_two_nations": "SELECT MIN(c_name) AS c, MIN(s_name) AS s, COUNT(*) AS n FROM customer, orders, lineitem, supplier WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND c_mktsegment LIKE 'B%' AND l_returnflag = 'A'",
    "job_late_parts": "SELECT MIN(p_type) AS t, MAX(p_name) AS p FROM part, lineitem, orders WHERE p_partkey = l_partkey AND l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 80 DAY AND p_size IN (1, 7, 13) AND o_orderpriority NOT LIKE '5%'",
    "job_empty": "SELECT MIN(p_name) AS p, MAX(c_name) AS c FROM part, lineitem, orders, customer WHERE p_partkey = l_partkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND p_size > 9999",
    "job_count": "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(c_acctbal), 6) AS a FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey IN (0, 3) AND l_tax < 0.03",
    "job_self_nation": "SELECT MIN(a.c_name) AS x, MAX(b.c_name) AS y, COUNT(*) AS n FROM customer a, customer b, nation WHERE a.c_nationkey = n_nationkey AND b.c_nationkey = n_nationkey AND a.c_custkey < b.c_custkey AND a.c_acctbal > 9000 AND b.c_acctbal < 0",
    "job_brand_or": "SELECT MIN(p_name) AS p, MIN(s_name) AS s, MIN(o_orderdate) AS d FROM part, lineitem, supplier, orders WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND (p_brand = 'Brand#7' OR p_brand = 'Brand#9' OR p_name LIKE '%widget%') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-06-30 00:00:00'",
    "job_nested_or": "SELECT MIN(c_name) AS c, MAX(n_name) AS n FROM customer, nation, orders WHERE c_nationkey = n_nationkey AND o_custkey = c_custkey AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AND o_totalprice > 200000) AND (c_mktsegment = 'BUILDING' OR c_acctbal > 5000)",
    "job_both_nations": "SELECT MIN(n1.n_name) AS a, MAX(n2.n_name) AS b, COUNT(*) AS n FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey <> n2.n_regionkey AND l_quantity > 45",
    "job_not_like": "SELECT MIN(p_type) AS t, MIN(p_name) AS p FROM part, lineitem WHERE p_partkey = l_partkey AND p_name NOT LIKE '%widget%' AND p_type IS NOT NULL AND p_type NOT IN ('ECONOMY', 'PROMO') AND l_returnflag <> 'N'",
    "job_eight_tables": "SELECT MIN(c_name) AS c, MIN(s_name) AS s, MIN(p_name) AS p, COUNT(*) AS n FROM region r1, nation n1, customer, orders, lineitem, part, supplier, nation n2 WHERE r1.r_regionkey = n1.n_regionkey AND n1.n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n2.n_nationkey AND n2.n_regionkey = r1.r_regionkey AND p_size < 20 AND o_orderstatus IN ('F', 'O')",
    "job_transitive": "SELECT MIN(a.o_totalprice) AS lo, MAX(a.o_totalprice) AS hi FROM orders a, lineitem b, lineitem c WHERE a.o_orderkey = b.l_orderkey AND b.l_orderkey = c.l_orderkey AND a.o_orderkey = c.l_orderkey AND b.l_linenumber < c.l_linenumber AND b.l_returnflag = 'R' AND c.l_returnflag = 'A'",
    "job_events_users": "SELECT MIN(c_name) AS c, COUNT(*) AS n, COUNT(DISTINCT user_id) AS u FROM events, customer, nation WHERE user_id = c_custkey AND c_nationkey = n_nationkey AND event_type = 'purchase' AND n_regionkey > 1",
    "job_document_labels": "SELECT MIN(source) AS s, MAX(lang) AS l, COUNT(*) AS n FROM documents, labels WHERE documents.doc_id = labels.doc_id AND quality = 1 AND toxic = 0 AND n_chars BETWEEN 200 AND 4000",
    "job_region_count": "SELECT r_name, COUNT(*) AS n, MIN(o_orderpriority) AS p FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY r_name HAVING COUNT(*) > 1",
    "job_count_self": "SELECT COUNT(*) AS n FROM nation a, nation b, region WHERE a.n_regionkey = b.n_regionkey AND b.n_regionkey = r_regionkey AND a.n_nationkey <> b.n_nationkey",
}

#: The shapes of a web analytics board, on events, pages, documents and conversations.
BOARD = {
    "board_count_all": "SELECT COUNT(*) AS n FROM events",
    "board_sum_avg": "SELECT ROUND(SUM(value), 4) AS s, COUNT(*) AS n, ROUND(AVG(user_id), 6) AS a FROM events",
    "board_distinct": "SELECT COUNT(DISTINCT user_id) AS u, COUNT(DISTINCT props) AS p FROM events",
    "board_min_max": "SELECT MIN(ts) AS lo, MAX(ts) AS hi FROM events",
    "board_group_filtered": "SELECT event_type, COUNT(*) AS c FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY c DESC, event_type",
    "board_top_minute": "SELECT EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS m, COUNT(*) AS c FROM events GROUP BY h, m ORDER BY c DESC, h, m LIMIT 10",
    "board_by_minute": "SELECT DATE_TRUNC('minute', ts) AS m, COUNT(*) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-14 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY DATE_TRUNC('minute', ts) ORDER BY m LIMIT 10 OFFSET 100",
    "board_like_count": "SELECT COUNT(*) AS c FROM pages WHERE url LIKE '%example.org%'",
    "board_like_top": "SELECT SUBSTRING(url, 1, 12) AS head, MIN(url) AS first_url, COUNT(*) AS c FROM pages WHERE url LIKE '%/en/%' AND html NOT LIKE '%no such text%' GROUP BY head ORDER BY c DESC, head LIMIT 10",
    "board_length": "SELECT lang, ROUND(AVG(LENGTH(text)), 4) AS l, COUNT(*) AS c FROM documents GROUP BY lang HAVING COUNT(*) > 5 ORDER BY l DESC",
    "board_shifted_keys": "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, user_id - 3 AS c, COUNT(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY n DESC, user_id LIMIT 10",
    "board_case_source": "SELECT CASE WHEN event_type = 'click' THEN props ELSE '' END AS src, COUNT(*) AS n FROM events WHERE user_id < 40 GROUP BY src ORDER BY n DESC, src LIMIT 10",
    "board_order_text": "SELECT props FROM events WHERE event_type = 'purchase' ORDER BY props, event_id LIMIT 10",
    "board_order_time": "SELECT event_id FROM events WHERE value > 10 ORDER BY ts, event_id LIMIT 10",
    "board_top_text_pair": "SELECT user_id, props, COUNT(*) AS c FROM events WHERE props <> '' GROUP BY user_id, props ORDER BY c DESC, user_id, props LIMIT 10",
    "board_mixed": "SELECT user_id, COUNT(*) AS c, ROUND(SUM(value), 4) AS s, ROUND(AVG(LENGTH(props)), 4) AS a FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    "board_first_turns": "SELECT role, COUNT(*) AS n, COUNT(DISTINCT conv_id) AS k FROM conversations GROUP BY role",
    "board_conversation_length": "SELECT n, COUNT(*) AS c FROM (SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id) t GROUP BY n",
    "board_point": "SELECT event_id, user_id, ts FROM events WHERE user_id = 17",
    "board_not_zero": "SELECT COUNT(*) AS c FROM events WHERE user_id <> 0",
    "board_avg_key": "SELECT ROUND(AVG(user_id), 6) AS a FROM events",
    "board_distinct_text": "SELECT COUNT(DISTINCT props) AS p FROM events",
    "board_users_by_type": "SELECT event_type, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "board_many_by_type": "SELECT event_type, ROUND(SUM(value), 4) AS s, COUNT(*) AS c, ROUND(AVG(user_id), 6) AS a, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "board_users_by_text": "SELECT props, COUNT(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "board_users_by_pair": "SELECT event_type, props, COUNT(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY u DESC, event_type, props LIMIT 10",
    "board_top_text": "SELECT props, COUNT(*) AS c FROM events WHERE props <> '' GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "board_top_type_text": "SELECT event_type, props, COUNT(*) AS c FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY c DESC, event_type, props LIMIT 10",
    "board_top_users": "SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    "board_user_minute_type": "SELECT user_id, EXTRACT(MINUTE FROM ts) AS m, event_type, COUNT(*) AS c FROM events GROUP BY user_id, m, event_type ORDER BY c DESC, user_id, m, event_type LIMIT 10",
    "board_like_two": "SELECT lang, MIN(source) AS first_source, MIN(text) AS first_text, COUNT(*) AS c, COUNT(DISTINCT source) AS u FROM documents WHERE text LIKE '%the%' AND source NOT LIKE '%.none.%' AND lang <> '' GROUP BY lang ORDER BY c DESC, lang LIMIT 10",
    "board_like_rows": "SELECT * FROM pages WHERE url LIKE '%utm_source%' ORDER BY url, page_id LIMIT 10",
    "board_order_time_text": "SELECT event_type, props FROM events WHERE props <> '' ORDER BY ts, props, event_id LIMIT 10",
    "board_host": "SELECT REGEXP_REPLACE(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS host, ROUND(AVG(LENGTH(url)), 4) AS l, COUNT(*) AS c, MIN(url) AS first_url FROM pages WHERE url <> '' GROUP BY host HAVING COUNT(*) > 1 ORDER BY l DESC, host LIMIT 25",
    "board_many_sums": "SELECT " + ", ".join(f"CAST(SUM(n_chars + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM documents",
    "board_pair_sums": "SELECT event_type, user_id, COUNT(*) AS c, ROUND(SUM(value), 4) AS s, ROUND(AVG(value), 6) AS a FROM events WHERE props <> '' GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10",
    "board_key_sums": "SELECT event_id, user_id, COUNT(*) AS c, ROUND(SUM(value), 4) AS s FROM events GROUP BY event_id, user_id ORDER BY c DESC, event_id LIMIT 10",
    "board_key_sums_filtered": "SELECT event_id, user_id, COUNT(*) AS c, ROUND(SUM(value), 4) AS s FROM events WHERE props <> '' GROUP BY event_id, user_id ORDER BY c DESC, event_id LIMIT 10",
    "board_top_url": "SELECT url, COUNT(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "board_constant_url": "SELECT 1 AS one, url, COUNT(*) AS c FROM pages GROUP BY one, url ORDER BY c DESC, url LIMIT 10",
    "board_period": "SELECT props, COUNT(*) AS views FROM events WHERE user_id < 30 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'click' AND props <> '' GROUP BY props ORDER BY views DESC, props LIMIT 10",
    "board_period_offset": "SELECT props, COUNT(*) AS views FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND event_type <> 'error' AND value <> 0 GROUP BY props ORDER BY views DESC, props LIMIT 10 OFFSET 20",
    "board_five_keys": "SELECT event_type, user_id, EXTRACT(DAY FROM ts) AS d, CASE WHEN event_type = 'view' AND value > 50 THEN props ELSE '' END AS src, props AS dst, COUNT(*) AS views FROM events WHERE user_id < 60 GROUP BY event_type, user_id, d, src, dst ORDER BY views DESC, event_type, user_id, d, src, dst LIMIT 10 OFFSET 30",
    "board_day_in": "SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS views FROM events WHERE event_type IN ('view', 'purchase') AND user_id IN (3, 5, 8, 13) GROUP BY user_id, day ORDER BY views DESC, user_id, day LIMIT 10 OFFSET 10",
    "board_two_sizes": "SELECT n_chars, lang, COUNT(*) AS views FROM documents WHERE source <> '' GROUP BY n_chars, lang ORDER BY views DESC, n_chars, lang LIMIT 10 OFFSET 5",
    "board_groups_any": "SELECT COUNT(*) AS n, COUNT(c) AS m, MIN(c) > 0 AS some FROM (SELECT user_id, event_type, COUNT(*) AS c FROM events GROUP BY user_id, event_type LIMIT 10) t",
}

SQL: dict[str, str] = {**TPCH, **PROJECTION, **JOINS, **SUBQUERIES, **AGGREGATES, **WINDOWS, **ORDER_AND_SETS, **SCALARS, **H2O, **JOB, **BOARD}
