"""Scalar-function families over table columns, through the dialect's functions."""

from __future__ import annotations

from .base import register_sql as _dialect

_dialect(
    "fn_string_case_length",
    """SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n1, len(c_name) AS n2, char_length(c_name) AS n3, character_length(c_name) AS n4,
    reverse(c_name) AS rev, repeat(c_mktsegment, 2) AS rep, initcap(lower(c_mktsegment) || ' x') AS ini, ascii(c_name) AS asc1, ascii('') AS asc0, chr(8364) AS euro FROM {customer}""",
    """SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n1, length(c_name) AS n2, length(c_name) AS n3, length(c_name) AS n4,
    reverse(c_name) AS rev, repeat(c_mktsegment, 2) AS rep, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' X' AS ini, ascii(c_name) AS asc1, NULL::INT AS asc0, chr(8364) AS euro FROM customer""",
)
_dialect(
    "fn_string_trim_pad",
    """SELECT p_partkey, trim('  ' || p_name || ' ') AS t1, trim('x' FROM 'xx' || p_name || 'x') AS t2, trim(LEADING 'x' FROM 'xx' || p_name || 'x') AS t3, ltrim('  ' || p_name) AS t4, ltrim('xx' || p_brand, 'x') AS t5,
    rtrim(p_brand || 'xx', 'x') AS t6, lpad(p_brand, 12, '*') AS l1, lpad(p_brand, 3, '*') AS l2, rpad(p_brand, 12, '*') AS r1, lpad(p_brand, 30, '') AS l3, left(p_name, 4) AS le, right(p_name, 4) AS ri, left(p_name, -1) AS le0 FROM {part}""",
    """SELECT p_partkey, p_name AS t1, trim('xx' || p_name || 'x', 'x') AS t2, ltrim('xx' || p_name || 'x', 'x') AS t3, p_name AS t4, ltrim('xx' || p_brand, 'x') AS t5,
    rtrim(p_brand || 'xx', 'x') AS t6, lpad(p_brand, 12, '*') AS l1, lpad(p_brand, 3, '*') AS l2, rpad(p_brand, 12, '*') AS r1, p_brand AS l3, left(p_name, 4) AS le, right(p_name, 4) AS ri, '' AS le0 FROM part""",
)
_dialect(
    "fn_string_search",
    """SELECT p_partkey, instr(p_name, 'a') AS i1, instr(p_name, '') AS i0, position('a' IN p_name) AS i2, position('' IN p_name) AS i3, split_part(p_type, ' ', 2) AS s2, split_part(p_type, ' ', 9) AS s9, substring(p_name, 2, 3) AS u1, substr(p_name, 0, 3) AS u2,
    substring(p_name FROM 2 FOR 3) AS u3, substring(p_name, 3) AS u4, replace(p_name, 'a', 'A') AS rp, concat(p_brand, '-', p_size) AS cc, concat_ws('/', p_brand, NULL, p_type) AS cw FROM {part}""",
    """SELECT p_partkey, instr(p_name, 'a') AS i1, 0 AS i0, instr(p_name, 'a') AS i2, 0 AS i3, nullif(split_part(p_type, ' ', 2), '') AS s2, NULL::VARCHAR AS s9, substring(p_name, 2, 3) AS u1, substring(p_name, 1, 2) AS u2,
    substring(p_name, 2, 3) AS u3, substring(p_name, 3) AS u4, replace(p_name, 'a', 'A') AS rp, p_brand || '-' || p_size AS cc, concat_ws('/', p_brand, NULL, p_type) AS cw FROM part""",
)
_dialect(
    "fn_numeric_rounding",
    """SELECT o_orderkey, abs(-o_totalprice) AS a, round(o_totalprice) AS r0, round(o_totalprice, 1) AS r1, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, trunc(-o_totalprice) AS t0, truncate(o_totalprice, 1) AS t1,
    mod(o_orderkey, 7) AS m, mod(o_orderkey, 0) AS m0, round(mod(o_totalprice, 7), 4) AS m1, mod(-7.5, 2) = -1.5 AS m2, CAST(ceil(o_totalprice, 1) AS DOUBLE) AS c1, ceiling(o_totalprice) AS c2, sign(o_totalprice - 100000) AS s FROM {orders}""",
    """SELECT o_orderkey, abs(-o_totalprice) AS a, round(o_totalprice)::BIGINT AS r0, floor(o_totalprice * 10 + 0.5) / 10 AS r1, ceil(o_totalprice)::BIGINT AS c, floor(o_totalprice)::BIGINT AS f, -floor(o_totalprice)::BIGINT AS t0, floor(o_totalprice * 10) / 10 AS t1,
    o_orderkey % 7 AS m, NULL::BIGINT AS m0, round(fmod(o_totalprice, 7), 4) AS m1, true AS m2, ceil(round(o_totalprice * 10, 6)) / 10 AS c1, ceil(o_totalprice)::BIGINT AS c2, sign(o_totalprice - 100000)::DOUBLE AS s FROM orders""",
)
_dialect(
    "fn_numeric_powers",
    """SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS sq, power(s_nationkey, 2) AS p2, pow(2, 3) AS p3, round(exp(s_nationkey / 10.0), 6) AS ex, round(ln(s_suppkey + 1), 6) AS l1, round(log10(s_suppkey + 1), 6) AS l2, round(log2(s_suppkey + 1), 6) AS l3,
    round(log(s_suppkey + 1), 6) AS l4, round(log(s_suppkey + 1, 2), 6) AS l5, round(pi(), 6) AS pi, greatest(s_suppkey, NULL, s_nationkey) AS g, least(s_suppkey, s_nationkey, NULL) AS l FROM {supplier}""",
    """SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS sq, power(s_nationkey, 2) AS p2, 8.0 AS p3, round(exp(s_nationkey / 10.0), 6) AS ex, round(ln(s_suppkey + 1), 6) AS l1, round(log10(s_suppkey + 1), 6) AS l2, round(log2(s_suppkey + 1), 6) AS l3,
    round(log10(s_suppkey + 1), 6) AS l4, round(log2(s_suppkey + 1), 6) AS l5, round(pi(), 6) AS pi, greatest(s_suppkey, s_nationkey) AS g, least(s_suppkey, s_nationkey) AS l FROM supplier""",
)
_dialect(
    "fn_arithmetic",
    """SELECT l_orderkey, l_linenumber, l_partkey + 1 AS a, l_partkey - l_suppkey AS b, l_quantity * 2 AS c, l_partkey div 3 AS d, l_extendedprice / l_quantity AS e, -l_tax AS f FROM {lineitem}""",
    """SELECT l_orderkey, l_linenumber, l_partkey + 1 AS a, l_partkey - l_suppkey AS b, l_quantity * 2 AS c, l_partkey // 3 AS d, l_extendedprice / l_quantity AS e, -l_tax AS f FROM lineitem""",
)
_dialect(
    "fn_division",
    """SELECT l_orderkey, l_linenumber, l_partkey / 3 AS a, (l_partkey + l_suppkey) / l_linenumber / 2 AS b, l_extendedprice / 4 AS c, -l_partkey / 2 AS d, l_partkey / 0 AS e, l_orderkey / (l_partkey - l_partkey) AS f,
    CAST(l_partkey AS DOUBLE) / 2 AS g, CASE WHEN l_partkey / 2 * 2 = l_partkey THEN 1 ELSE 0 END AS h, typeof(l_partkey / 2) AS i FROM {lineitem}""",
    """SELECT l_orderkey, l_linenumber, l_partkey // 3 AS a, ((l_partkey + l_suppkey) // l_linenumber) // 2 AS b, l_extendedprice / 4 AS c, -(l_partkey // 2) AS d, NULL::BIGINT AS e, NULL::BIGINT AS f,
    l_partkey::DOUBLE / 2 AS g, (l_partkey % 2 = 0)::INT AS h, 'integer' AS i FROM lineitem""",
)
_dialect(
    "fn_null_typeof",
    """SELECT event_id, coalesce(NULL, event_type) AS c1, ifnull(NULL, event_id) AS c2, nullif(event_type, 'click') AS n1, typeof(event_type) AS t1, typeof(event_id) AS t2, typeof(value) AS t3, typeof(event_id > 3) AS t4, typeof(NULL) AS t5 FROM {events}""",
    """SELECT event_id, event_type AS c1, event_id AS c2, nullif(event_type, 'click') AS n1, 'text' AS t1, 'integer' AS t2, CASE WHEN value IS NULL THEN 'null' ELSE 'float' END AS t3, 'boolean' AS t4, 'null' AS t5 FROM events""",
)
_dialect(
    "fn_json_events",
    """SELECT event_id, json_extract(props, 'k') AS k, CAST(json_extract(props, '$.k') AS INT) + 1 AS k1, json_extract(props, 'missing') AS m FROM {events}""",
    """SELECT event_id, props->>'$.k' AS k, (props->>'$.k')::INT + 1 AS k1, props->>'$.missing' AS m FROM events""",
)
_dialect(
    "fn_time_text",
    """SELECT length(now()) AS a, length(current_date()) AS b, length(current_time()) AS c, now() >= '2024-01-01 00:00:00' AS d FROM {region}""",
    """SELECT 19 AS a, 10 AS b, 8 AS c, true AS d FROM region""",
)
_dialect(
    "fn_match_score",
    """SELECT item_id, match(text, 'the of') AS m, match(text, '') AS m0, round(score(text, 'the de'), 9) AS s, slug(text) AS sl FROM {benchmark}""",
    r"""SELECT item_id, list_contains(t, 'the') AND list_contains(t, 'of') AS m, false AS m0, round((len(list_filter(t, lambda x: x = 'the')) + len(list_filter(t, lambda x: x = 'de'))) / len(t), 9) AS s,
    regexp_replace(trim(regexp_replace(lower(text), '[^\p{L}\p{N} ]', '-', 'g')), '\s+', '-', 'g') AS sl FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark)""",
)
_dialect(
    "fn_group_concat",
    "SELECT n_regionkey, group_concat(n_name) AS names, group_concat(n_name, '; ') AS names2 FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, '; ' ORDER BY n_name) AS names2 FROM nation GROUP BY n_regionkey",
)
_dialect(
    "filter_ilike",
    "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment LIKE '%build%' AND c_name NOT LIKE '%_0'",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_name NOT ILIKE '%_0'",
)
