"""Projection, filters, joins, aggregation, windows, ordering and set operations.

Where a text has no second one, the same SQL runs on both engines."""

from pyspark.sql import functions as F

from ..operators import stats
from .base import query, sql

# --- projection and predicates

sql("b_projection", """
SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
  -l_quantity AS neg, l_orderkey % 7 AS m, l_returnflag || '-' || l_linestatus AS flag, NOT (l_quantity > 25) AS small
FROM lineitem""")
sql("b_case_cast_nullif", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code, CAST(floor(o_totalprice) AS BIGINT) AS whole,
  CAST(o_orderkey AS VARCHAR(20)) AS key_text, NULLIF(o_orderstatus, 'F') AS not_f, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS filled
FROM orders""", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code, CAST(floor(o_totalprice) AS BIGINT) AS whole,
  CAST(o_orderkey AS VARCHAR) AS key_text, NULLIF(o_orderstatus, 'F') AS not_f, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS filled
FROM orders""")
sql("b_interval", """
SELECT o_orderkey, o_orderdate + INTERVAL '7' DAY AS plus_week, o_orderdate - INTERVAL '3' HOUR AS minus_hours, o_orderdate + INTERVAL '1' MONTH AS plus_month
FROM orders""")
sql("b_filters", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND o_orderkey <> 3 AND o_totalprice BETWEEN 1000 AND 450000
  AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderstatus NOT IN ('P') AND o_orderpriority >= '1' AND o_totalprice NOT BETWEEN 5000 AND 6000""")
sql("b_or_across_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 1 OR l_discount = 0.05 OR (l_tax > 0.07 AND l_returnflag = 'R')")
sql("b_like", """
SELECT p_partkey, p_name, p_name LIKE '%1%' AS a, p_type LIKE '_%' AS b, p_name ILIKE '%PART%' AS c, p_type NOT LIKE 'S%' AS d, p_brand NOT ILIKE '%#1%' AS e
FROM part""")
sql("b_nulls", """
SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') IS NULL AS is_null, NULLIF(c_mktsegment, 'BUILDING') IS NOT NULL AS is_set,
  NULLIF(c_mktsegment, 'BUILDING') = 'BUILDING' AS cmp, NULLIF(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM NULL AS safe
FROM customer""")
sql("b_in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
sql("b_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
sql("b_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("b_not_exists", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
sql("b_scalar_subquery", """
SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS above
FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)""")
sql("b_correlated_scalar", """
SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer""")
sql("b_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql("b_distinct_on", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
sql("b_qualify", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2""",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 2""")

# --- joins

sql("c_inner", """
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
sql("c_left", """
SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
sql("c_right", """
SELECT s_suppkey, n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 12) n RIGHT JOIN supplier ON n_nationkey = s_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
sql("c_full", """
SELECT c.k AS ck, s.k AS sk, c.n AS cn, s.n AS sn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) c
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY 1) s ON c.k = s.k""")
sql("c_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("c_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql("c_using_and", """
SELECT a.o_custkey, count(*) AS pairs FROM orders a JOIN orders b USING (o_custkey, o_orderstatus) WHERE a.o_orderkey < b.o_orderkey GROUP BY 1""",
    """SELECT o_custkey, count(*) AS pairs FROM orders a JOIN orders b USING (o_custkey, o_orderstatus) WHERE a.o_orderkey < b.o_orderkey GROUP BY 1""")
sql("c_non_equi", """
SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
sql("c_semi", "SELECT s_suppkey, s_name FROM supplier LEFT SEMI JOIN lineitem ON s_suppkey = l_suppkey AND l_discount > 0.09",
    "SELECT s_suppkey, s_name FROM supplier SEMI JOIN lineitem ON s_suppkey = l_suppkey AND l_discount > 0.09")
sql("c_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
    "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
sql("c_self", """
SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
sql("c_lateral", """
SELECT c_custkey, x.o_orderkey, x.o_totalprice FROM customer, LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x""")
sql("c_lateral_left", """
SELECT c_custkey, x.total FROM customer LEFT JOIN LATERAL (SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') x ON true""")
sql("c_generate_series", """
SELECT o_orderkey, d FROM orders LATERAL VIEW explode(sequence(1, CAST(o_orderkey % 4 AS INT) + 1)) s AS d""",
    "SELECT o_orderkey, unnest(generate_series(1, CAST(o_orderkey % 4 AS INT) + 1))::INT AS d FROM orders")
sql("c_regexp_matches", """
SELECT p_partkey, m FROM part LATERAL VIEW explode(regexp_extract_all(p_name, '[0-9]+', 0)) e AS m""",
    "SELECT p_partkey, unnest(regexp_extract_all(p_name, '[0-9]+')) AS m FROM part")
sql("c_range_join", """
SELECT w.k AS w, count(*) AS n FROM (SELECT n_nationkey AS k, n_nationkey * 40000.0 AS lo, n_nationkey * 40000.0 + 60000 AS hi FROM nation) w
JOIN orders ON o_totalprice >= w.lo AND o_totalprice < w.hi GROUP BY 1""")

# --- aggregation

sql("d_basic", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS supps, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
  min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp,
  round(variance(l_quantity), 6) AS var, round(var_pop(l_quantity), 6) AS varp FROM lineitem GROUP BY l_returnflag, l_linestatus""")
sql("d_count_col", """
SELECT o_orderpriority, count(*) AS all_rows, count(NULLIF(o_orderstatus, 'F')) AS not_f, count(DISTINCT NULLIF(o_orderstatus, 'F')) AS kinds FROM orders GROUP BY o_orderpriority""")
# Spark's percentile() keeps all values of a group in one task; the operator takes ranges of them.


@query("d_percentiles", """
SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
  quantile_disc(l_extendedprice, 0.25) AS d25, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 4) AS iqr
FROM lineitem GROUP BY l_returnflag""")
def d_percentiles(t):
    price = stats.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"med": ("cont", 0.5), "p95": ("cont", 0.95), "d25": ("disc", 0.25)})
    amount = stats.percentiles(t.lineitem, ["l_returnflag"], "l_quantity", {"q1": ("cont", 0.25), "q3": ("cont", 0.75)}).withColumnRenamed("l_returnflag", "k")
    return price.join(amount, F.col("l_returnflag").eqNullSafe(F.col("k"))).select(
        "l_returnflag", F.round("med", 4).alias("med"), F.round("p95", 4).alias("p95"), "d25", F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"))


sql("d_string_agg", """
SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_nationkey DESC) AS back FROM nation GROUP BY n_regionkey""",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, '|' ORDER BY n_nationkey DESC) AS back FROM nation GROUP BY n_regionkey")
sql("d_array_agg", """
SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ';') AS names, size(collect_set(n_regionkey)) AS kinds,
  array_join(transform(sort_array(collect_list(struct(-n_nationkey, n_name))), x -> x.n_name), ';') AS ordered FROM nation GROUP BY n_regionkey""",
    """SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ';') AS names, len(array_agg(DISTINCT n_regionkey))::INT AS kinds,
  array_to_string(array_agg(n_name ORDER BY n_nationkey DESC), ';') AS ordered FROM nation GROUP BY n_regionkey""")
sql("d_mode", """
SELECT o_custkey, min_by(o_orderpriority, struct(-n, o_orderpriority)) AS mode FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey""",
    """SELECT o_custkey, o_orderpriority AS mode FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
sql("d_first_last_nth", """
SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS first, max_by(o_totalprice, o_orderkey) AS last,
  get(transform(sort_array(collect_list(struct(o_orderkey, o_totalprice))), x -> x.o_totalprice), 1) AS second FROM orders GROUP BY o_custkey""",
    """SELECT o_custkey, first(o_totalprice ORDER BY o_orderkey) AS first, last(o_totalprice ORDER BY o_orderkey) AS last,
  array_agg(o_totalprice ORDER BY o_orderkey)[2] AS second FROM orders GROUP BY o_custkey""")
sql("d_filter", """
SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_returnflag = 'R'), 4) AS tax_r,
  count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) AS an, max(l_discount) FILTER (WHERE l_linestatus LIKE 'O%') AS disc FROM lineitem GROUP BY l_suppkey""")
sql("d_group_by_all", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
sql("d_grouping_sets", """
SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", """
SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g1, grouping(l_linestatus)::TINYINT AS g2, count(*) AS n FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
sql("d_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
# The rows are counted once at the finest grain; the cube expands those few groups only.
sql("d_cube", """
WITH g AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, l_linenumber, sum(n) AS n FROM g GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
sql("d_having", """
SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500 AND avg(l_quantity) > 25""")
sql("d_bits_bool", """
SELECT l_returnflag, bit_and(l_linenumber) AS band, bit_or(l_linenumber) AS bor, bit_xor(l_linenumber) AS bxor, bool_and(l_quantity > 0) AS every_one, bool_or(l_quantity > 49) AS any_one FROM lineitem GROUP BY l_returnflag""")
sql("d_regression", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
  round(corr(l_extendedprice, l_quantity), 6) AS r, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY l_returnflag""", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
  round(corr(l_extendedprice, l_quantity), 6) AS r, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY l_returnflag""")
sql("d_regr_sums", """
SELECT l_linestatus, round(regr_sxx(l_tax, l_quantity), 2) AS sxx, round(regr_syy(l_tax, l_quantity), 4) AS syy, round(regr_sxy(l_tax, l_quantity), 3) AS sxy FROM lineitem GROUP BY l_linestatus""")
sql("d_moments", """
SELECT l_returnflag, round(CASE WHEN count(l_extendedprice) >= 3 THEN skewness(l_extendedprice) END, 6) AS skew, round(CASE WHEN count(l_extendedprice) >= 4 THEN kurtosis(l_extendedprice) END, 6) AS kurt FROM lineitem GROUP BY l_returnflag""", """
WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(avg((l_extendedprice - a) ** 3) / pow(avg((l_extendedprice - a) ** 2), 1.5), 6) AS skew, round(avg((l_extendedprice - a) ** 4) / pow(avg((l_extendedprice - a) ** 2), 2) - 3, 6) AS kurt
FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY l.l_returnflag""")
sql("d_pivot", """
SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
sql("d_unpivot", """
SELECT l_orderkey, l_linenumber, what, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, NULLIF(l_tax, 0.0) AS l_tax FROM lineitem) UNPIVOT (amount FOR what IN (l_discount, l_tax))""", """
SELECT l_orderkey, l_linenumber, 'l_discount' AS what, l_discount AS amount FROM lineitem WHERE l_discount IS NOT NULL UNION ALL
SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem WHERE NULLIF(l_tax, 0.0) IS NOT NULL""")

# --- windows

sql("e_ranking", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 8) AS pr, round(cume_dist() OVER p, 8) AS cd, ntile(4) OVER w AS nt
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""", """
SELECT o_orderkey, (row_number() OVER w)::INT AS rn, (rank() OVER p)::INT AS rk, (dense_rank() OVER p)::INT AS dr, round(percent_rank() OVER p, 8) AS pr, round(cume_dist() OVER p, 8) AS cd, (ntile(4) OVER w)::INT AS nt
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
sql("e_offset", """
SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0) OVER w AS after2, first_value(value) OVER w AS first, nth_value(value, 3) OVER w AS third,
  last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
sql("e_aggregates", """
SELECT event_id, round(sum(value) OVER w, 4) AS s, round(avg(value) OVER w, 4) AS a, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
sql("e_frames", """
SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near,
  round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS rest, l_partkey, l_suppkey, l_extendedprice FROM lineitem""")
sql("e_groups_frame", """
SELECT o_orderkey, sum(c) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (
  SELECT o_orderkey, o_custkey, 1 AS c, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS g FROM orders)""",
    """SELECT o_orderkey, sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM orders""")
sql("e_partition_expression", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_totalprice * -1, o_orderkey) AS rn FROM orders",
    "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_totalprice * -1, o_orderkey))::INT AS rn FROM orders")

# --- order, limit

sql("f_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST LIMIT 25")
sql("f_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 15")
sql("f_fetch", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey FETCH FIRST 5 ROWS ONLY")
sql("f_null_order", """
SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg NULLS FIRST, c_custkey LIMIT 40""")
sql("f_top_k_groups", "SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 10")
sql("f_collation", "SELECT p_partkey, collate(p_type, 'UNICODE_CI') = collate(upper(p_type), 'UNICODE_CI') AS same FROM part",
    "SELECT p_partkey, lower(p_type) = lower(upper(p_type)) AS same FROM part")

# --- set operations, CTEs

sql("g_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("g_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("g_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
sql("g_intersect_all", "SELECT l_linenumber AS k FROM lineitem WHERE l_tax > 0.05 INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_tax < 0.02")
sql("g_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
sql("g_except_all", "SELECT l_linenumber AS k FROM lineitem EXCEPT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
sql("g_setop_order_limit", "WITH a AS (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region) SELECT x FROM a ORDER BY x LIMIT 12")
sql("g_cte", """
WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 1000000)
SELECT c_mktsegment, count(*) AS n FROM top JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
sql("g_recursive", """
WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r JOIN nation ON n = n_nationkey""")
sql("g_ttl", "SELECT event_id FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
sql("g_time_travel", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
WHERE valid_from <= TIMESTAMP_NTZ '1996-06-30 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP_NTZ '1996-06-30 00:00:00')""", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
WHERE valid_from <= TIMESTAMP '1996-06-30 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-30 00:00:00')""")
