"""The relational surface: statements of the kinds that analysts' questions turn into. One text serves both engines."""

from __future__ import annotations

from lorespark.sources.tables import NAMES, sql_over

STATEMENTS = {
    # filter and projection
    "rel_filter_projection": "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
    "rel_filter_like": "SELECT p_partkey, p_name, p_brand FROM {part} WHERE p_name LIKE '%ring%' AND p_size <= 10",
    "rel_filter_null_safe": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus IS NOT DISTINCT FROM 'F' AND o_totalprice >= 400000",
    # aggregation
    "rel_agg_global": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM {orders}",
    "rel_agg_filter_clause": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM {orders}",
    "rel_agg_bool": "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS all_above, bool_or(o_totalprice > 490000) AS any_high FROM {orders} GROUP BY o_orderpriority",
    "rel_agg_distinct": "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days, count(*) AS n FROM {orders}",
    # group by
    "rel_group_by": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus, o_orderpriority",
    "rel_group_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) >= 12",
    "rel_group_left_join": "SELECT n.n_name, count(c.c_custkey) AS customers, round(coalesce(sum(c.c_acctbal), 0), 2) AS balance FROM {nation} n LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY n.n_name",
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM {lineitem} WHERE l_shipdate <= DATE '2001-09-02' GROUP BY l_returnflag, l_linestatus",
    "rel_revenue_change": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24",
    # ordering and top-k
    "rel_top_k": "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "rel_top_k_group": "SELECT c_nationkey, round(sum(c_acctbal), 2) AS balance FROM {customer} GROUP BY c_nationkey ORDER BY balance DESC, c_nationkey LIMIT 5",
    # several predicates
    "rel_predicates": "SELECT o_orderkey FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 100000 AND 150000 AND o_orderpriority <> '5-LOW' AND NOT (o_custkey % 7 = 0)",
    # joins
    "rel_join_inner": "SELECT n.n_name, count(*) AS n, round(avg(c.c_acctbal), 4) AS mean FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name",
    "rel_join_three": "SELECT r.r_name, count(DISTINCT c.c_custkey) AS customers, count(*) AS orders FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
    "rel_join_five": "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = c.c_nationkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name",
    "rel_join_self": "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "rel_join_cross": "SELECT r.r_name, s.o_orderstatus FROM {region} r CROSS JOIN (SELECT DISTINCT o_orderstatus FROM {orders}) s",
    "rel_join_theta": "SELECT s.s_suppkey, count(*) AS poorer FROM {supplier} s JOIN {supplier} t ON t.s_nationkey = s.s_nationkey AND t.s_acctbal < s.s_acctbal GROUP BY s.s_suppkey",
    "rel_join_full": "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_customers, coalesce(b.n, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k",
    "rel_join_lateral": "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t WHERE c.c_nationkey = 3",
    "rel_semi_join": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)",
    "rel_anti_join": "SELECT c.c_custkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL",
    # dates
    "rel_date_range": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-03-01'",
    "rel_date_month": "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1, 2",
    # nulls and empty results
    "rel_null_coalesce": "SELECT n.n_name, coalesce(sum(s.s_acctbal), 0) > 0 AS positive, count(s.s_suppkey) AS n FROM {nation} n LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9500 GROUP BY n.n_name",
    "rel_null_order": "SELECT s.s_suppkey, p.p_size FROM {supplier} s LEFT JOIN {part} p ON p.p_partkey = s.s_suppkey * 50 ORDER BY p.p_size ASC NULLS LAST, s.s_suppkey LIMIT 30",
    "rel_empty": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate > DATE '2030-01-01' AND o_orderpriority LIKE '9%'",
    "rel_empty_aggregate": "SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderkey) AS low FROM {orders} WHERE o_totalprice < 0",
    # derived columns
    "rel_scalar_subquery": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM {orders})",
    "rel_share": "SELECT o_orderpriority, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS share FROM {orders} GROUP BY o_orderpriority",
    "rel_cte": "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), ranked AS (SELECT c.c_nationkey, max(s.total) AS top FROM spend s JOIN {customer} c ON c.c_custkey = s.o_custkey GROUP BY c.c_nationkey) SELECT c_nationkey, round(top, 2) AS top FROM ranked WHERE top > (SELECT avg(top) FROM ranked)",
    "rel_case": "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM {orders} GROUP BY 1",
    # set operations
    "set_01_union": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000",
    "set_01_union_all": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000",
    "set_01_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderpriority = '5-LOW'",
    "set_01_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000",
    "set_03_cte_union": "WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey), b AS (SELECT k FROM a WHERE q > 1200 UNION SELECT p_partkey FROM {part} WHERE p_size = 50) SELECT count(*) AS n, min(k) AS low, max(k) AS high FROM b",
    # grouping sets
    "agg_34_rollup": "SELECT r.r_name, n.n_name, count(*) AS n FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)",
    "agg_34_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_34_grouping_sets": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    # windows
    "win_01_ranks": "SELECT c_custkey, c_nationkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    "win_01_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_01_values": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_01_running": "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM {events}",
    # aggregates of the allow-list that build values
    "agg_33_values": "SELECT n_regionkey, count(*) AS n, bool_and(n_nationkey >= 0) AS all_set, max(n_name) AS last FROM {nation} GROUP BY n_regionkey",
    # scalar functions of the allow-list
    "fn_math": "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal, 1) AS r, round(power(c_acctbal, 2), 2) AS p, round(sqrt(abs(c_acctbal)), 6) AS s, mod(c_custkey, 7) AS m, greatest(c_nationkey, 5) AS g, least(c_nationkey, 5) AS l FROM {customer}",
    "fn_string": "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS le, char_length(c_name) AS cl, substring(c_name, 10, 5) AS su, right(c_name, 3) AS ri, replace(c_name, '#', '-') AS re, split_part(c_name, '#', 2) AS sp, concat_ws('/', c_name, c_mktsegment) AS cw, trim(c_mktsegment) AS tr, position('#' IN c_name) AS po FROM {customer}",
    "fn_conditional": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, CAST(c_acctbal AS DECIMAL(12, 2)) AS d, CAST(c_custkey AS VARCHAR(20)) AS v FROM {customer}",
    "fn_date": "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(extract(day FROM o_orderdate) AS INT) AS d, CAST(date_part('year', o_orderdate) AS INT) AS y, CAST(o_orderdate AS DATE) AS day FROM {orders}",
}

_plain = {n: n for n in NAMES}


def _query(text: str):
    return lambda spark, sf_dir: sql_over(spark, sf_dir, text)


QUERIES = {name: _query(text) for name, text in STATEMENTS.items()}
ORACLE = {name: text.format(**_plain) for name, text in STATEMENTS.items()}

#: Statements whose texts differ between the engines: (ours, the other's).
PAIRS = {
    "agg_33_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_33_array_agg": ("SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), '|') AS names, array_size(array_agg(n_name)) AS n FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names, CAST(len(array_agg(n_name)) AS INT) AS n FROM nation GROUP BY n_regionkey"),
    "agg_33_json_agg": ("SELECT r_regionkey, to_json(named_struct('k', r_regionkey, 'n', r_name)) AS j FROM {region}", "SELECT r_regionkey, CAST(json_object('k', r_regionkey, 'n', r_name) AS VARCHAR) AS j FROM region"),
    "fn_regexp_replace": ("SELECT c_custkey, regexp_replace(c_name, '[0-9]', '') AS letters FROM {customer}", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '', 'g') AS letters FROM customer"),
    "fn_to_date": ("SELECT o_orderkey, to_date(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd') AS d, date_format(o_orderdate, 'yyyy/MM') AS ym FROM {orders}", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y/%m') AS ym FROM orders"),
}
QUERIES |= {name: _query(ours) for name, (ours, _) in PAIRS.items()}
ORACLE |= {name: other for name, (_, other) in PAIRS.items()}
