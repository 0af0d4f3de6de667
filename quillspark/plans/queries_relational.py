"""Relational operators: joins, aggregation, sorting, set operations, subqueries, CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import register, register_sql, table

# filters and projections
register_sql("scan_all", "SELECT * FROM {nation}")
register_sql("project_alias", "SELECT s.*, s_acctbal * 2 AS twice, s_nationkey AS nk FROM {supplier} s")
register_sql("filter_comparisons", "SELECT o_orderkey FROM {orders} WHERE o_totalprice >= 50000 AND o_totalprice < 100000 AND o_orderstatus <> 'F' AND NOT (o_custkey <= 10 OR o_custkey > 1000)")
register_sql("filter_in_between", "SELECT p_partkey, p_size FROM {part} WHERE p_size IN (1, 5, 9) OR (p_size BETWEEN 20 AND 22 AND p_brand NOT IN ('Brand#11', 'Brand#12')) OR p_size NOT BETWEEN 2 AND 48")
register_sql("filter_null", "SELECT event_id FROM {events} WHERE nullif(event_type, 'view') IS NULL OR value IS NULL")
register_sql("case_bucket", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bucket, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS returned, count(*) AS n FROM {lineitem} GROUP BY 1, 2")
register_sql("cast_types", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_totalprice AS BIGINT) AS b, CAST('7' AS INT) + 1 AS i FROM {orders}", "SELECT o_orderkey, o_orderkey::VARCHAR AS s, trunc(o_totalprice)::BIGINT AS b, 8 AS i FROM orders")
register_sql("null_safe_equality", "SELECT count(*) AS n FROM {events} a JOIN {events} b ON a.event_id = b.event_id AND (nullif(a.event_type, 'view') <=> nullif(b.event_type, 'view'))", "SELECT count(*) AS n FROM events")
register_sql("no_from_values", "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)")

# joins
register_sql("join_inner", "SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
register_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY c_custkey")
register_sql("join_right_full", "SELECT a.n_nationkey AS k1, b.k2 FROM (SELECT * FROM {nation} WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k2 FROM {nation} WHERE n_nationkey > 5) b ON a.n_nationkey = b.k2")
register_sql("join_using", "SELECT l.l_orderkey, count(*) AS n FROM {lineitem} l JOIN (SELECT o_orderkey AS l_orderkey, o_orderstatus FROM {orders}) o USING (l_orderkey) WHERE o_orderstatus = 'F' GROUP BY l.l_orderkey", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey")
register_sql("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey + 1 = b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
register_sql("join_cross", "SELECT r_name, n_name FROM {region}, {nation} WHERE r_regionkey < 2 AND n_nationkey < 5")
register_sql("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")


@register("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# aggregation
register_sql(
    "agg_group",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
)
register_sql("agg_global", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_open, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM {orders}")
register_sql("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total FROM {orders} WHERE o_orderkey < 0")
register_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
register_sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag")
register_sql("agg_expression_key", "SELECT lower(o_orderpriority) AS p, count(*) + 1 AS n FROM {orders} GROUP BY lower(o_orderpriority)")
register_sql("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
register_sql("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, round(sum(value) FILTER (WHERE value <= 50), 4) AS small FROM {events} GROUP BY event_type")
register_sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")

# distinct, order, limit
register_sql("distinct_rows", "SELECT DISTINCT p_brand, p_size FROM {part}")
register_sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
register_sql("limit_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 30")
register_sql("order_by_alias_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM {customer} ORDER BY nk DESC NULLS LAST, c_custkey LIMIT 40")
register_sql("distinct_after_order", "SELECT DISTINCT o_orderpriority FROM {orders} ORDER BY o_orderpriority LIMIT 3")

# set operations
register_sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
register_sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
register_sql("intersect", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'")
register_sql("except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")

# subqueries and CTEs
register_sql("subq_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})")
register_sql("subq_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 49) AND p_brand NOT IN (SELECT p_brand FROM {part} WHERE p_size = 1 AND p_retailprice < 905)")
register_sql("subq_correlated", "SELECT s_suppkey FROM {supplier} s WHERE s_acctbal > (SELECT avg(x.s_acctbal) FROM {supplier} x WHERE x.s_nationkey = s.s_nationkey)")
register_sql("subq_derived", "SELECT n.k, count(*) AS n FROM (SELECT o_custkey % 10 AS k FROM {orders}) n GROUP BY n.k")
register_sql("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM big GROUP BY o_custkey) SELECT c_name, per.n, per.total FROM per JOIN {customer} ON c_custkey = o_custkey WHERE per.n >= 3")
register_sql("cte_shadowing", "WITH nation AS (SELECT n_regionkey FROM {nation} WHERE n_nationkey < 10) SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 10 GROUP BY n_regionkey")
register_sql("cte_recursive_seq", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT s.n, count(p_partkey) AS parts FROM s LEFT JOIN {part} ON p_size = s.n GROUP BY s.n")


register_sql(
    "cte_recursive_dedup",
    "WITH RECURSIVE r(n) AS (SELECT CAST(n_nationkey AS BIGINT) FROM {nation} WHERE n_nationkey < 3 UNION SELECT (n * n + 3) % 101 FROM r) SELECT n FROM r",
)
register_sql("join_natural", "SELECT n_nationkey, n_name, twice FROM {nation} NATURAL JOIN (SELECT n_nationkey, n_nationkey * 2 AS twice FROM {nation}) d WHERE twice > 10")
register_sql("join_after_comma", "SELECT r_name, n_name, count(c_custkey) AS n FROM {region}, {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey WHERE r_regionkey = n_regionkey GROUP BY r_name, n_name")
