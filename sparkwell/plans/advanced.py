"""As-of and range joins, merge-tree tables, DML, statistics, time series, graph, text, vectors,
data quality, sampling, functions of users."""

from pyspark.sql import functions as F

from ..operators import dataquality, dml, graph, joins, mergetree, stats, text, timeseries, vector_search
from ..sources import files, tables
from .base import query, run_sql

# --- joins


def _asof_sides(t):
    left = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    return left, right


_ASOF = """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT l.event_id, r.ts AS r_ts, r.v AS r_v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {op} r.ts"""


@query("c_asof_backward", _ASOF.format(op=">="))
def c_asof_backward(t):
    return joins.asof_join(*_asof_sides(t), on="ts", by=["user_id"]).select("event_id", "r_ts", "r_v")


@query("c_asof_forward", _ASOF.format(op="<="))
def c_asof_forward(t):
    return joins.asof_join(*_asof_sides(t), on="ts", by=["user_id"], direction="forward").select("event_id", "r_ts", "r_v")


@query("c_asof_tolerance", _ASOF.format(op=">=").replace("r.ts AS r_ts, r.v AS r_v", "CASE WHEN l.ts - r.ts <= INTERVAL '6 hours' THEN r.ts END AS r_ts, CASE WHEN l.ts - r.ts <= INTERVAL '6 hours' THEN r.v END AS r_v"))
def c_asof_tolerance(t):
    return joins.asof_join(*_asof_sides(t), on="ts", by=["user_id"], tolerance=6 * 3600).select("event_id", "r_ts", "r_v")


@query("c_asof_nearest", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT event_id, r_ts, r_v FROM (SELECT l.event_id, r.ts AS r_ts, r.v AS r_v, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) AS k
  FROM l LEFT JOIN r ON l.user_id = r.user_id) WHERE k = 1""")
def c_asof_nearest(t):
    return joins.asof_join(*_asof_sides(t), on="ts", by=["user_id"], direction="nearest").select("event_id", "r_ts", "r_v")


@query("c_range_join_cells", """
SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_totalprice >= n_nationkey * 15000 AND o_totalprice < n_nationkey * 15000 + 20000""")
def c_range_join_cells(t):
    spans = t.nation.select("n_nationkey", (F.col("n_nationkey") * 15000.0).alias("lo"), (F.col("n_nationkey") * 15000.0 + 20000).alias("hi"))
    return joins.range_join(t.orders, spans, "o_totalprice", "lo", "hi", 20000.0).select("o_orderkey", "n_nationkey")


@query("c_salted_join", "SELECT l_returnflag, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def c_salted_join(t):
    big = t.lineitem.select("l_returnflag", F.col("l_suppkey").alias("k"))
    return joins.salted_join(big, t.supplier.select(F.col("s_suppkey").alias("k"), "s_nationkey"), ["k"]).groupBy("l_returnflag", "s_nationkey").agg(F.count("*").alias("n"))


@query("a_dictionary_lookup", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def a_dictionary_lookup(t):
    return joins.dictionary_lookup(t.customer, t.nation.filter("n_nationkey < 20"), "c_nationkey", "n_nationkey", "n_name", "none").select("c_custkey", "n_name")


# --- merge-tree tables


@query("d_replacing", "SELECT o_custkey, o_orderkey AS version, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def d_replacing(t):
    return mergetree.replacing(t.orders.select("o_custkey", F.col("o_orderkey").alias("version"), "o_totalprice"), ["o_custkey"], "version")


@query("d_collapsing", """
WITH r AS (SELECT user_id, event_id, value, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign FROM events), g AS (SELECT user_id, sum(sign) AS s FROM r GROUP BY 1)
SELECT r.user_id, event_id, value, sign FROM r JOIN g ON r.user_id = g.user_id WHERE (s > 0 AND sign = 1) OR (s < 0 AND sign = -1)
QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY event_id DESC) = 1""")
def d_collapsing(t):
    rows = t.events.select("user_id", "event_id", "value", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"))
    return mergetree.collapsing(rows, ["user_id"], "sign", "event_id")


@query("d_versioned_collapsing", """
SELECT user_id, version, CASE WHEN s > 0 THEN 1 ELSE -1 END AS sign FROM (SELECT user_id, event_id % 4 AS version, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS s FROM events GROUP BY ALL) WHERE s <> 0""")
def d_versioned_collapsing(t):
    rows = t.events.select("user_id", (F.col("event_id") % 4).alias("version"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"))
    return mergetree.versioned_collapsing(rows, ["user_id"], "sign", "version")


@query("d_summing", "SELECT l_suppkey, sum(l_linenumber)::BIGINT AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1 HAVING n <> 0 OR qty <> 0")
def d_summing(t):
    return mergetree.summing(t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("qty")), ["l_suppkey"], ["n", "qty"]).withColumn("qty", F.round("qty", 2))


@query("d_aggregating", "SELECT l_returnflag, count(*) AS n, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1")
def d_aggregating(t):
    parts = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))
    return mergetree.aggregating(parts, ["l_returnflag"], sums=["n"], mins=["lo"], maxs=["hi"])


@query("d_incremental_view", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def d_incremental_view(t):
    old, new = t.orders.filter("o_orderkey % 5 <> 0"), t.orders.filter("o_orderkey % 5 = 0")
    view = old.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    return tables.incremental_sum_refresh(view, new, ["o_orderstatus"], {"total": "o_totalprice"}).withColumn("total", F.round("total", 2))


@query("d_projection_rollup", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def d_projection_rollup(t):
    daily = t.orders.groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return daily.groupBy(F.date_trunc("month", "day").cast("timestamp_ntz").alias("month")).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


# --- DML as snapshots

_SOURCE = "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 10 = 0"


@query("g_merge", f"""
WITH t AS (SELECT c_custkey, c_acctbal FROM customer), s AS ({_SOURCE})
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal
FROM t FULL JOIN s ON t.c_custkey = s.c_custkey WHERE NOT (t.c_custkey IS NOT NULL AND s.c_custkey IS NOT NULL AND s.c_acctbal < 0)""")
def g_merge(t):
    return dml.merge(t.customer.select("c_custkey", "c_acctbal"), run_sql(t, _SOURCE), ["c_custkey"], delete_when=F.col("s_c_acctbal") < 0)


@query("a_upsert", f"WITH s AS ({_SOURCE}) SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s")
def a_upsert(t):
    return dml.upsert(t.customer.select("c_custkey", "c_acctbal"), run_sql(t, _SOURCE), ["c_custkey"])


@query("g_update", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def g_update(t):
    return dml.update(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), F.col("s_nationkey") < 10, {"s_acctbal": F.col("s_acctbal") * 2}).select("s_suppkey", "s_acctbal")


@query("g_delete_using", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def g_delete_using(t):
    kept = dml.delete(t.part.select("p_partkey", "p_size"), F.col("p_size") < 10)
    return dml.delete_using(kept, t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"]).select("p_partkey")


@query("a_change_log", """
SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 4 NOT IN (0, 1) UNION ALL SELECT s_suppkey, s_acctbal + 5 FROM supplier WHERE s_suppkey % 4 = 1""")
def a_change_log(t):
    base = t.supplier.select("s_suppkey", "s_acctbal")
    ups = base.filter("s_suppkey % 4 = 1").select("s_suppkey", (F.col("s_acctbal") + 5).alias("s_acctbal"), F.lit("u").alias("op"), F.lit(2).alias("at"))
    first = ups.withColumns({"s_acctbal": F.lit(0.0), "at": F.lit(1)})
    gone = base.filter("s_suppkey % 4 = 0").select("s_suppkey", "s_acctbal", F.lit("d").alias("op"), F.lit(3).alias("at"))
    return tables.apply_changes(base, ups.unionByName(first).unionByName(gone), ["s_suppkey"], "at")


# --- statistics


@query("d_t_test", """
SELECT round((avg(l_quantity) - 25) / (stddev(l_quantity) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM lineitem""")
def d_t_test(t):
    return stats.t_test_one(t.lineitem, "l_quantity", 25.0).withColumn("t", F.round("t", 6))


@query("d_welch", """
WITH a AS (SELECT avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mb,
  var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') / count(*) FILTER (WHERE l_returnflag = 'A') AS sa, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') / count(*) FILTER (WHERE l_returnflag = 'R') AS sb,
  count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'R') AS nb FROM lineitem)
SELECT round((ma - mb) / sqrt(sa + sb), 6) AS t, round(pow(sa + sb, 2) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 3) AS df FROM a""")
def d_welch(t):
    return stats.t_test_two(t.lineitem, "l_returnflag", "A", "R", "l_extendedprice").select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query("d_chi_square", """
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL), r AS (SELECT a, sum(o) AS r FROM c GROUP BY a), k AS (SELECT b, sum(o) AS k FROM c GROUP BY b), n AS (SELECT sum(o) AS n FROM c)
SELECT round(sum(pow(coalesce(o, 0) - r * k / n::DOUBLE, 2) / (r * k / n::DOUBLE)), 4) AS chi2, ((count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1))::BIGINT AS df
FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b""")
def d_chi_square(t):
    return stats.chi_square_independence(t.lineitem, "l_returnflag", "l_linestatus").withColumn("chi2", F.round("chi2", 4))


@query("d_chi_square_fit", """
WITH g AS (SELECT o_orderstatus AS k, count(*) AS o FROM orders GROUP BY 1), n AS (SELECT sum(o)::DOUBLE AS n FROM g), e(k, p) AS (VALUES ('F', 0.4), ('O', 0.4), ('P', 0.2))
SELECT round(sum(pow(coalesce(o, 0) - p * n, 2) / (p * n)), 3) AS chi2, (count(*) - 1)::BIGINT AS df FROM e LEFT JOIN g USING (k) CROSS JOIN n""")
def d_chi_square_fit(t):
    return stats.chi_square_fit(t.orders, "o_orderstatus", {"F": 0.4, "O": 0.4, "P": 0.2}).withColumn("chi2", F.round("chi2", 3))


@query("d_anova", """
WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT avg(c_acctbal) AS mean FROM customer)
SELECT round((sum(n * pow(m - mean, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) AS f, (count(*) - 1)::BIGINT AS df_between, (sum(n) - count(*))::BIGINT AS df_within FROM g, t""")
def d_anova(t):
    return stats.anova(t.customer, "c_mktsegment", "c_acctbal").withColumn("f", F.round("f", 4))


@query("o_psi")
def o_psi(t):
    a, b = t.events.filter("event_id % 2 = 0"), t.events.filter("event_id % 2 = 1")
    return stats.population_stability(a, b, "value", [20.0, 40.0, 60.0, 80.0])


@query("d_sketches")
def d_sketches(t):
    return stats.approximate(t.lineitem, ["l_returnflag"], "l_partkey")


@query("d_approx_top_k")
def d_approx_top_k(t):
    return stats.approx_top_k(t.events, "event_type", 5)


@query("d_count_min")
def d_count_min(t):
    return stats.count_min(t.events, "user_id").select(F.length("sketch").alias("bytes"))


# --- time series


def _series(t):
    return t.events.groupBy("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("value").alias("value"))


_S = "WITH s AS (SELECT event_type, (epoch_us(ts) // 1000) AS ts, max(value) AS value FROM events GROUP BY ALL) "


@query("o_ts_aggregate", _S + """
SELECT event_type, (ts // 86400000) * 86400000 AS bucket, round(sum(value), 4) AS sum, round(avg(value) + 1e-9, 6) AS avg, min(value) AS min, max(value) AS max, count(value) AS count,
  arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(stddev_pop(value), 5) AS stddev, round(var_pop(value), 4) AS variance,
  round((arg_max(value, ts) - arg_min(value, ts)) / count(value), 6) AS rate, round(arg_max(value, ts) - arg_min(value, ts), 6) AS delta, round(greatest(arg_max(value, ts) - arg_min(value, ts), 0), 6) AS increase FROM s GROUP BY 1, 2""")
def o_ts_aggregate(t):
    # A trifle keeps means off the exact halves, which the engines round differently.
    out = timeseries.aggregate(_series(t), ["event_type"], "ts", "value", 86_400_000).withColumn("avg", F.col("avg") + 1e-9)
    digits = {"sum": 4, "avg": 6, "stddev": 5, "variance": 4, "rate": 6, "delta": 6, "increase": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("o_ts_percentile", _S + """
SELECT event_type, bucket, v[(floor(0.9 * (len(v) - 1)))::INT + 1] AS value FROM (SELECT event_type, (ts // 86400000) * 86400000 AS bucket, list_sort(list(value)) AS v FROM s GROUP BY 1, 2)""")
def o_ts_percentile(t):
    return timeseries.percentile(_series(t), ["event_type"], "ts", "value", 86_400_000, 90)


@query("o_ts_downsample", _S + "SELECT event_type, (ts // 3600000) * 3600000 AS bucket, round(avg(value), 6) AS value FROM s GROUP BY 1, 2")
def o_ts_downsample(t):
    return timeseries.downsample(_series(t), ["event_type"], "ts", "value", 3_600_000).withColumn("value", F.round("value", 6))


@query("o_ts_rate", _S + """
SELECT event_type, ts, value, round(CASE WHEN dt > 0 THEN dv / dt ELSE 0 END, 8) AS rate FROM (
  SELECT *, (ts - lag(ts) OVER w) / 1000.0 AS dt, value - lag(value) OVER w AS dv FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE dt IS NOT NULL""")
def o_ts_rate(t):
    return timeseries.rate(_series(t), ["event_type"], "ts", "value").withColumn("rate", F.round("rate", 8))


@query("o_ts_integral", _S + "SELECT event_type, ts, value, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), 3) AS integral FROM s")
def o_ts_integral(t):
    return timeseries.integral(_series(t), ["event_type"], "ts", "value").withColumn("integral", F.round("integral", 3))


@query("o_ts_moving_average", _S + "SELECT event_type, ts, value, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS 4 PRECEDING), 6) AS moving_average FROM s")
def o_ts_moving_average(t):
    return timeseries.moving_average(_series(t), ["event_type"], "ts", "value", 5).withColumn("moving_average", F.round("moving_average", 6))


@query("o_ts_ema", """
WITH RECURSIVE s AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT user_id, (epoch_us(ts) // 1000) AS ts, max(value) AS value FROM events GROUP BY ALL)),
e AS (SELECT user_id, ts, value, i, value AS ema FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.ts, s.value, s.i, 0.3 * s.value + 0.7 * e.ema FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1)
SELECT user_id, ts, value, round(ema, 6) AS ema FROM e""")
def o_ts_ema(t):
    rows = t.events.groupBy("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("value").alias("value"))
    return timeseries.exponential_moving_average(rows, ["user_id"], "ts", "value", 0.3).withColumn("ema", F.round("ema", 6))


_HOURS = "h AS (SELECT user_id, ((epoch_us(ts) // 1000) // 21600000) * 21600000 AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"


@query("o_ts_gap_fill", f"""
WITH {_HOURS}, sp AS (SELECT user_id, unnest(range(min(ts), max(ts) + 1, 21600000)) AS ts FROM h GROUP BY user_id),
j AS (SELECT sp.user_id, sp.ts, value, max(CASE WHEN value IS NOT NULL THEN sp.ts END) OVER (PARTITION BY sp.user_id ORDER BY sp.ts) AS pt,
  min(CASE WHEN value IS NOT NULL THEN sp.ts END) OVER (PARTITION BY sp.user_id ORDER BY sp.ts DESC) AS nt FROM sp LEFT JOIN h ON sp.user_id = h.user_id AND sp.ts = h.ts)
SELECT j.user_id, j.ts, round(coalesce(j.value, p.value + (n.value - p.value) * (j.ts - pt) / nullif(nt - pt, 0)), 6) AS value, j.value IS NULL AS filled
FROM j JOIN h p ON p.user_id = j.user_id AND p.ts = pt JOIN h n ON n.user_id = j.user_id AND n.ts = nt""")
def o_ts_gap_fill(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    h = t.events.groupBy("user_id", (F.floor(ms / 21600000) * 21600000).cast("long").alias("ts")).agg(F.avg("value").alias("value"))
    return timeseries.gap_fill(h, ["user_id"], "ts", "value", 21_600_000).withColumn("value", F.round("value", 6))


@query("o_ts_anomalies", """
WITH g AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(*) AS c FROM events GROUP BY 1)
SELECT event_id, round((value - m) / s, 5) AS zscore FROM events JOIN g USING (event_type) WHERE c >= 3 AND s > 0 AND abs((value - m) / s) > 1.6""")
def o_ts_anomalies(t):
    return timeseries.detect_anomalies(t.events, ["event_type"], "value", 1.6).select("event_id", F.round("zscore", 5).alias("zscore"))


@query("o_ts_forecast", """
WITH d AS (SELECT event_type, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS ts, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w - 1 AS i, lead(ts) OVER w - ts AS gap FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT event_type, regr_slope(value, i) AS a, regr_intercept(value, i) AS b, count(*) AS n, max(ts) AS hi, arg_min(gap, i) AS step FROM r GROUP BY 1)
SELECT event_type, hi + step * k AS ts, round(b + a * (n - 1 + k), 5) AS value FROM g, range(1, 6) x(k) WHERE n >= 2""")
def o_ts_forecast(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    d = t.events.groupBy("event_type", (F.floor(ms / 86400000) * 86400000).cast("long").alias("ts")).agg(F.count("*").cast("double").alias("value"))
    return timeseries.forecast(d, ["event_type"], "ts", "value", 5).withColumn("value", F.round("value", 5))


@query("o_ts_decompose", _S + """
SELECT event_type, ts, value, round(t, 6) AS trend, round(value - t, 6) AS seasonal, 0.0::DOUBLE AS residual FROM (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS 6 PRECEDING) AS t FROM s)""")
def o_ts_decompose(t):
    return timeseries.decompose(_series(t), ["event_type"], "ts", "value", 7).withColumns({c: F.round(c, 6) for c in ("trend", "seasonal")})


# --- graph: suppliers and the nations and regions above them, or users linked through events


def _edges(t):
    """Customers to nations to regions; ids of the three kinds lie apart."""
    up = t.customer.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("dst"))
    top = t.nation.select((F.col("n_nationkey") + 1_000_000).cast("long").alias("src"), (F.col("n_regionkey") + 2_000_000).cast("long").alias("dst"))
    side = t.nation.filter("n_nationkey > 0").select((F.col("n_nationkey") + 999_999).cast("long").alias("src"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("dst"))
    return up.union(top).union(side)


_E = """e AS (SELECT c_custkey AS src, c_nationkey + 1000000 AS dst FROM customer UNION ALL SELECT n_nationkey + 1000000, n_regionkey + 2000000 FROM nation
  UNION ALL SELECT n_nationkey + 999999, n_nationkey + 1000000 FROM nation WHERE n_nationkey > 0)"""


@query("o_graph_bfs", f"""
WITH RECURSIVE {_E}, b(node, depth) AS (SELECT 1000000::BIGINT, 0 UNION SELECT e.dst::BIGINT, depth + 1 FROM b JOIN e ON b.node = e.src WHERE depth < 8) SELECT node, min(depth) AS depth FROM b GROUP BY 1""")
def o_graph_bfs(t):
    return graph.bfs(_edges(t), 1_000_000, 8)


@query("o_graph_shortest_path", f"""
WITH RECURSIVE {_E}, w AS (SELECT src, dst, (1 + (src + dst) % 5)::DOUBLE AS w FROM e), b(node, cost, n) AS (SELECT 1000000::BIGINT, 0::DOUBLE, 0 UNION SELECT w.dst::BIGINT, cost + w, n + 1 FROM b JOIN w ON b.node = w.src WHERE n < 30)
SELECT node, min(cost) AS cost FROM b GROUP BY 1""")
def o_graph_shortest_path(t):
    e = _edges(t).withColumn("weight", 1 + (F.col("src") + F.col("dst")) % 5)
    return graph.shortest_path(e, 1_000_000).select("node", "cost")


@query("o_graph_all_paths", f"""
WITH RECURSIVE {_E}, b(node, path) AS (SELECT 1000000::BIGINT, [1000000::BIGINT] UNION ALL SELECT e.dst::BIGINT, list_append(path, e.dst::BIGINT) FROM b JOIN e ON b.node = e.src WHERE len(path) < 7 AND NOT list_contains(path, e.dst) AND node <> 2000001)
SELECT array_to_string(path, '>') AS path FROM b WHERE node = 2000001""")
def o_graph_all_paths(t):
    return graph.all_paths(_edges(t), 1_000_000, 2_000_001, 7).select(F.array_join("path", ">").alias("path"))


def _pagerank_sql(rounds: int) -> str:
    steps = ", ".join(
        f"r{i} AS (SELECT v.node, 0.15 / n + 0.85 * coalesce(sum(r{i - 1}.rank / deg), 0) AS rank FROM v CROSS JOIN c LEFT JOIN d ON d.dst = v.node LEFT JOIN r{i - 1} ON r{i - 1}.node = d.src GROUP BY v.node, n)"
        for i in range(1, rounds + 1))
    return f"""WITH {_E}, d0 AS (SELECT DISTINCT src::BIGINT AS src, dst::BIGINT AS dst FROM e), d AS (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM d0),
v AS (SELECT src AS node FROM d0 UNION SELECT dst FROM d0), c AS (SELECT count(*) AS n FROM v), r0 AS (SELECT node, 1.0 / n AS rank FROM v, c), {steps} SELECT node, round(rank + 1e-11, 8) AS rank FROM r{rounds}"""


@query("o_graph_pagerank", _pagerank_sql(5))
def o_graph_pagerank(t):
    return graph.pagerank(_edges(t), rounds=5).withColumn("rank", F.round(F.col("rank") + 1e-11, 8))  # off the exact halves


_CC = """SELECT DISTINCT c_custkey AS src, c_nationkey + 1000000 AS dst FROM customer"""


@query("o_graph_components", f"""WITH e AS ({_CC}), m AS (SELECT dst, min(src) AS c FROM e GROUP BY 1) SELECT src AS node, c AS component FROM e JOIN m USING (dst) UNION ALL SELECT dst, c FROM m""")
def o_graph_components(t):
    e = t.customer.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("dst"))
    return graph.connected_components(e)


@query("o_graph_communities")
def o_graph_communities(t):
    return graph.label_propagation(_edges(t), 5)


@query("o_graph_neighbors", f"WITH {_E} SELECT DISTINCT node::BIGINT AS node FROM (SELECT dst AS node FROM e WHERE src = 1000003 UNION ALL SELECT src FROM e WHERE dst = 1000003)")
def o_graph_neighbors(t):
    return graph.neighbors(_edges(t), 1_000_003, "both")


@query("o_graph_stats", f"WITH {_E} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges, 2.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS avg_degree")
def o_graph_stats(t):
    return graph.stats(_edges(t))


# --- text


_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("m_bm25", f"""
WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents), c AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'thon')) AS b FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0""")
def m_bm25(t):
    return text.bm25(t.documents, "doc_id", "text", ["the", "thon"]).withColumn("score", F.round("score", 6))


@query("m_phrase", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the([^\p{L}\p{N}]|$)')")
def m_phrase(t):
    return t.documents.filter(text.phrase(F.col("text"), ["of", "the"])).select("doc_id")


@query("m_boolean", f"SELECT doc_id FROM (SELECT doc_id, {_TOK} AS t FROM documents) WHERE list_contains(t, 'the') AND list_has_any(t, ['thon', 'erha']) AND NOT list_contains(t, 'idiot')")
def m_boolean(t):
    return t.documents.filter(text.boolean(F.col("text"), ["the"], ["thon", "erha"], ["idiot"])).select("doc_id")


@query("m_highlight", "SELECT doc_id, regexp_replace(text, '\\b(the|and)\\b', '<b>\\1</b>', 'gi') AS h, CASE WHEN position('the' IN lower(text)) > 0 THEN substr(text, greatest(position('the' IN lower(text)) - 20, 1), 40) END AS s FROM documents")
def m_highlight(t):
    return t.documents.select("doc_id", text.headline(F.col("text"), ["the", "and"]).alias("h"), text.snippet(F.col("text"), "the").alias("s"))


@query("m_postings", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def m_postings(t):
    return text.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# --- vectors


@query("m_knn", """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_distance(embedding::DOUBLE[], q), 5) AS distance FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10""")
def m_knn(t):
    q = t.embeddings.filter("vec_id = 0").select("embedding").head()[0]
    return vector_search.knn(t.embeddings, "vec_id", "embedding", q, 10).withColumn("distance", F.round("distance", 5))


@query("m_knn_filtered", """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 5) AS distance FROM embeddings, q WHERE label = 3 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 5""")
def m_knn_filtered(t):
    q = t.embeddings.filter("vec_id = 0").select("embedding").head()[0]
    return vector_search.knn(t.embeddings, "vec_id", "embedding", q, 5, "cosine", F.col("label") == 3).withColumn("distance", F.round("distance", 5))


@query("m_batch_knn", """
SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), d.vec_id)::INT AS rank
  FROM embeddings q JOIN embeddings d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def m_batch_knn(t):
    return vector_search.batch_knn(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")


@query("m_hybrid_rrf", """
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1], vec_id) - 1 AS r FROM embeddings QUALIFY r < 50), b AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2], vec_id) - 1 AS r FROM embeddings QUALIFY r < 50)
SELECT vec_id, round(coalesce(0.5 / (61 + a.r), 0) + coalesce(0.5 / (61 + b.r), 0), 8) AS score FROM a FULL JOIN b USING (vec_id)""")
def m_hybrid_rrf(t):
    def ranked(i):
        top = t.embeddings.select("vec_id", F.get("embedding", F.lit(i)).alias("x")).orderBy("x", "vec_id").limit(50)
        arr = top.agg(F.sort_array(F.collect_list(F.struct("x", "vec_id"))).alias("a"))  # 50 rows
        return arr.select(F.posexplode("a").alias("rank", "s")).select(F.col("s.vec_id").alias("vec_id"), "rank")

    return vector_search.reciprocal_rank_fusion(ranked(0), ranked(1), "vec_id").withColumn("score", F.round("score", 8))


@query("m_similar_pairs", """
SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5""")
def m_similar_pairs(t):
    return vector_search.similar_pairs(t.embeddings, "vec_id", "embedding", "label", 0.5).select("a", "b")


@query("m_ivf")
def m_ivf(t):
    model, rows = vector_search.ivf(t.embeddings, "vec_id", "embedding", 8)
    q = t.embeddings.filter("vec_id = 0").select("embedding").head()[0]
    return vector_search.ivf_search(model, rows, "vec_id", "embedding", q, 10, 8)


@query("m_quantize", """
WITH q AS (SELECT vec_id, [CAST(round((least(greatest(x, -1), 1) + 1) / 2 * 255) AS INT) FOR x IN embedding::DOUBLE[]] AS c, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding::DOUBLE[]] AS b FROM embeddings)
SELECT vec_id, list_sum(c)::BIGINT AS code_sum, list_sum(b)::BIGINT AS ones FROM q""")
def m_quantize(t):
    e = F.col("embedding").cast("array<double>")
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return t.embeddings.select("vec_id", add(vector_search.scalar_quantize(e, -1.0, 1.0)).alias("code_sum"), add(vector_search.binary_quantize(e)).alias("ones"))


# --- data quality


@query("o_validate", """
SELECT unnest(['key', 'status', 'price', 'len']) AS rule, unnest([count(*) FILTER (WHERE o_orderkey IS NOT NULL), count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')), count(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 300000), count(*) FILTER (WHERE length(o_orderpriority) BETWEEN 5 AND 8)]) AS passed,
  unnest([count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FILTER (WHERE NOT o_orderstatus IN ('F', 'O')), count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 300000), count(*) FILTER (WHERE NOT length(o_orderpriority) BETWEEN 5 AND 8)]) AS failed FROM orders""")
def o_validate(t):
    r = dataquality.rule
    return dataquality.validate(t.orders, {
        "key": r("not_null", "o_orderkey"), "status": r("in_set", "o_orderstatus", "F", "O"), "price": r("range", "o_totalprice", 1000, 300000), "len": r("length", "o_orderpriority", 5, 8)})


@query("o_foreign_key", "SELECT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def o_foreign_key(t):
    return dataquality.foreign_key_violations(t.customer.select("c_nationkey"), "c_nationkey", t.nation.filter("n_nationkey < 20"), "n_nationkey")


@query("o_unique", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def o_unique(t):
    return dataquality.unique_violations(t.orders, ["o_custkey"])


@query("o_profile", """
SELECT 'n_nationkey' AS name, count(*) AS n, count(*) - count(n_nationkey) AS nulls, count(DISTINCT n_nationkey) AS distinct_n, min(n_nationkey)::VARCHAR AS min, max(n_nationkey)::VARCHAR AS max FROM nation UNION ALL
SELECT 'n_name', count(*), count(*) - count(n_name), count(DISTINCT n_name), min(n_name), max(n_name) FROM nation""")
def o_profile(t):
    return dataquality.profile(t.nation, ["n_nationkey", "n_name"])


@query("o_quality_score", """
SELECT round((0.3 * (count(o_orderkey) * 100.0 / count(*) + count(o_orderstatus) * 100.0 / count(*)) + 0.4 * (count(*) FILTER (WHERE o_totalprice < 200000) * 100.0 / count(*))
  + 0.3 * (count(DISTINCT o_orderkey) * 100.0 / count(*) + count(DISTINCT o_orderstatus) * 100.0 / count(*)) / 2) / 1.3, 6) AS score FROM orders""")
def o_quality_score(t):
    return dataquality.quality_score(t.orders, ["o_orderkey", "o_orderstatus"], {"p": F.col("o_totalprice") < 200000}).select(F.round("score", 6).alias("score"))


@query("o_features", """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS standard,
  round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 6) AS minmax, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS log1p FROM customer""")
def o_features(t):
    return dataquality.transforms(t.customer, "c_acctbal").select("c_custkey", *[F.round(c, 6).alias(c) for c in ("standard", "minmax", "log1p")])


# --- sampling, sources, user functions


@query("a_sample_bernoulli")
def a_sample_bernoulli(t):
    return files.sample(t.lineitem, "BERNOULLI", 10, seed=3).agg(F.count("*").alias("n"))


@query("a_sample_reservoir", "SELECT 100::BIGINT AS n")
def a_sample_reservoir(t):
    return files.sample(t.orders, "RESERVOIR", 100, seed=3).agg(F.count("*").alias("n"))


@query("a_sample_hash")
def a_sample_hash(t):
    return files.sample(t.orders, "HASH", 20, key="o_custkey").select("o_orderkey")


@query("a_snapshot_table", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_suppkey <= 10")
def a_snapshot_table(t):
    import uuid

    rows = t.supplier.select("s_suppkey", "s_acctbal")
    table = tables.SnapshotTable(t.spark, f"{tables.shared_dir(t.spark)}/sparkwell/snap-{uuid.uuid4().hex}")
    table.write(rows)
    table.write(rows.filter("s_suppkey <= 10").withColumn("s_suppkey", F.col("s_suppkey") + 1000000), "append")
    return table.read()


@query("a_copy_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a_copy_round_trip(t):
    import uuid

    base = f"{tables.shared_dir(t.spark)}/sparkwell/copy-{uuid.uuid4().hex}"
    rows = t.nation
    for k, fmt in enumerate(("csv", "json", "orc", "parquet")):
        files.copy_to(rows, f"{base}/{k}", fmt)
        rows = files.copy_from(t.spark, f"{base}/{k}", "n_nationkey int, n_name string, n_regionkey int", fmt)
    return rows.select("n_nationkey", "n_name", "n_regionkey")


@query("p_sql_function", "SELECT o_orderkey, o_totalprice * 1.19::DOUBLE AS gross FROM orders")
def p_sql_function(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sw_gross(x DOUBLE) RETURNS DOUBLE RETURN x * 1.19D")
    return t.orders.select("o_orderkey", F.call_function("sw_gross", "o_totalprice").alias("gross"))


@query("p_pandas_udf", "SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def p_pandas_udf(t):
    import pandas as pd

    @F.pandas_udf("int")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return t.part.select("p_partkey", twice("p_size").alias("y"))


@query("p_udaf", "SELECT l_returnflag, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY 1")
def p_udaf(t):
    """A user's aggregate as two stages of built-ins: sum of squares and count merge anywhere."""
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sqrt(F.avg(F.col("l_quantity") * F.col("l_quantity"))), 6).alias("rms"))


@query("p_udtf", "SELECT n_nationkey, unnest(range(0, n_nationkey % 3 + 1))::INT AS i FROM nation")
def p_udtf(t):
    @F.udtf(returnType="i int")
    class Count:
        def eval(self, n: int):
            for i in range(n + 1):
                yield (i,)

    t.spark.udtf.register("sw_count", Count)
    return run_sql(t, "SELECT n_nationkey, c.i FROM nation, LATERAL sw_count(n_nationkey % 3) c")


@query("p_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def p_parameters(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :s", args={"least": 300000, "s": "F"})


@query("p_identity", "SELECT n_nationkey, (row_number() OVER (ORDER BY n_name))::INT AS id, n_nationkey * 10 + n_regionkey AS gen FROM nation")
def p_identity(t):
    return run_sql(t, "SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS id, n_nationkey * 10 + n_regionkey AS gen FROM nation")
