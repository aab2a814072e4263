"""Time travel, sketches, geography, search syntax, drift, vectors, streams and small scalars."""

import uuid

from pyspark.sql import functions as F

from ..functions import geo, jsonpath, masking
from ..operators import dml, sketches, stats, temporal, vector_search
from ..operators import text as fulltext
from ..sources import tables
from ..streaming import windows
from .base import query, run_sql, sql
from .streams import _ntz

# --- versions, views, updates


def _versions(t):
    rows = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return temporal.versions(rows.withColumn("since", F.col("o_orderdate").cast("date")).drop("o_orderdate"), ["o_custkey"], "since")


_V = """WITH r AS (SELECT o_custkey, o_orderdate::DATE AS since, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate),
v AS (SELECT *, lead(since) OVER (PARTITION BY o_custkey ORDER BY since) AS til FROM r) SELECT o_custkey, o_orderkey FROM v WHERE """


@query("g_travel_as_of", _V + "since <= DATE '1995-06-01' AND (til IS NULL OR til > DATE '1995-06-01')")
def g_travel_as_of(t):
    return temporal.as_of(_versions(t), F.lit("1995-06-01").cast("date")).select("o_custkey", "o_orderkey")


@query("g_travel_from_to", _V + "since < DATE '1995-06-01' AND (til IS NULL OR til > DATE '1994-06-01')")
def g_travel_from_to(t):
    return temporal.from_to(_versions(t), F.lit("1994-06-01").cast("date"), F.lit("1995-06-01").cast("date")).select("o_custkey", "o_orderkey")


@query("g_travel_between", _V + "since <= DATE '1995-06-01' AND (til IS NULL OR til > DATE '1994-06-01')")
def g_travel_between(t):
    return temporal.between(_versions(t), F.lit("1994-06-01").cast("date"), F.lit("1995-06-01").cast("date")).select("o_custkey", "o_orderkey")


@query("g_travel_all", _V + "true")
def g_travel_all(t):
    return _versions(t).select("o_custkey", "o_orderkey")


@query("g_update_from", "SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def g_update_from(t):
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return temporal.update_from(t.customer.select("c_custkey", "c_acctbal"), best, ["c_custkey"], {"c_acctbal": F.col("s_m")})


@query("g_view", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def g_view(t):
    name = f"positive_{uuid.uuid4().hex}"
    t.customer.filter("c_acctbal > 0").createOrReplaceTempView(name)
    return t.spark.sql(f"SELECT c_mktsegment, count(*) AS n FROM {name} GROUP BY c_mktsegment")


@query("g_stored_view", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def g_stored_view(t):
    """A materialised view in a snapshot table, refreshed by the new rows only."""
    view = tables.SnapshotTable(t.spark, f"{tables.shared_dir(t.spark)}/sparkwell/view-{uuid.uuid4().hex}")
    group = lambda d: d.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    view.write(group(t.orders.filter("o_orderkey % 3 <> 0")))
    view.write(tables.incremental_sum_refresh(view.read(), t.orders.filter("o_orderkey % 3 = 0"), ["o_orderstatus"], {"total": "o_totalprice"}))
    return view.read().withColumn("total", F.round("total", 2))


@query("a_at_version", "SELECT n_nationkey, 1 AS v FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, 2 FROM nation")
def a_at_version(t):
    table = tables.SnapshotTable(t.spark, f"{tables.shared_dir(t.spark)}/sparkwell/versions-{uuid.uuid4().hex}")
    first = table.write(t.nation.filter("n_regionkey = 0").select("n_nationkey"))
    second = table.write(t.nation.select("n_nationkey"))
    return table.read(first).withColumn("v", F.lit(1)).unionByName(table.read(second).withColumn("v", F.lit(2)))


@query("a_partition_pruning", "SELECT event_id, event_type, true AS pruned FROM events WHERE event_type = 'purchase'")
def a_partition_pruning(t):
    path = f"{tables.shared_dir(t.spark)}/sparkwell/parted-{uuid.uuid4().hex}"
    t.events.select("event_id", "event_type").write.partitionBy("event_type").parquet(path)
    rows = t.spark.read.parquet(path).filter("event_type = 'purchase'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return rows.select("event_id", "event_type", F.lit("PartitionFilters: [isnotnull(event_type" in plan).alias("pruned"))


@query("g_explain", "SELECT true AS pushed, true AS pruned")
def g_explain(t):
    """The filter reaches the scan and only two columns are read."""
    text = run_sql(t, "SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
    plan = t.spark.createDataFrame([(text._jdf.queryExecution().explainString(
        t.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string")
    return plan.select(F.col("plan").contains("GreaterThan(l_quantity,49.0)").alias("pushed"),
                       (F.col("plan").contains("ReadSchema: struct<l_orderkey:") & ~F.col("plan").contains("l_comment")).alias("pruned"))


@query("c_bloom_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def c_bloom_join(t):
    """A Bloom filter of the small side before the exact join."""
    keys = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    maybe = sketches.bloom_maybe(sketches.bloom(keys, "l_partkey", 20_000), t.lineitem, "l_partkey").filter("maybe").select("l_partkey")
    return t.lineitem.join(maybe, "l_partkey", "left_semi").join(keys, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


sql("c_sort_merge", "SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey WHERE o_orderstatus = 'P'",
    "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")

# --- sketches


@query("d_count_min_estimate", "SELECT user_id, true AS fits FROM events GROUP BY user_id")
def d_count_min_estimate(t):
    true = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    guess = sketches.count_min_estimate(sketches.count_min(t.events, "user_id"), true, "user_id")
    total = t.events.count()  # estimates exceed counts by e / width of all rows at most, but for a chance of exp(-depth)
    return true.join(guess, "user_id").select("user_id", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + 0.01 * total)).alias("fits"))


@query("d_bloom", "SELECT true AS all_found, true AS few_false")
def d_bloom(t):
    inside, outside = t.orders.select(F.col("o_orderkey").alias("k")), t.orders.select((-F.col("o_orderkey") - 1).alias("k"))
    made = sketches.bloom(inside, "k", inside.count())
    a = sketches.bloom_maybe(made, inside, "k").agg(F.min("maybe").alias("all_found"))
    b = sketches.bloom_maybe(made, outside, "k").agg((F.avg(F.col("maybe").cast("double")) < 0.03).alias("few_false"))
    return a.crossJoin(b)  # one row each


@query("d_t_digest", "SELECT l_returnflag, true AS median_fits, true AS tail_fits FROM lineitem GROUP BY 1")
def d_t_digest(t):
    made = tables.checkpoint(sketches.t_digest(t.lineitem, ["l_returnflag"], "l_extendedprice"))
    exact = stats.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {n: ("cont", x) for n, x in (("p0", 0.47), ("p1", 0.53), ("p2", 0.985), ("p3", 0.995))})
    out = exact.join(sketches.t_digest_quantile(made, ["l_returnflag"], 0.5).withColumnRenamed("value", "m"), "l_returnflag")
    out = out.join(sketches.t_digest_quantile(made, ["l_returnflag"], 0.99).withColumnRenamed("value", "h"), "l_returnflag")
    return out.select("l_returnflag", F.col("m").between(F.col("p0"), F.col("p1")).alias("median_fits"), F.col("h").between(F.col("p2"), F.col("p3")).alias("tail_fits"))


@query("d_approx_bounds", "SELECT l_returnflag, true AS distinct_fits, true AS median_fits FROM lineitem GROUP BY 1")
def d_approx_bounds(t):
    # Sketches, distinct values and percentiles apart: together, each distinct value would hold a state of every percentile.
    key = "l_returnflag"
    guess = t.lineitem.groupBy(key).agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("l_quantity", 0.5, 1000).alias("m"))
    exact = t.lineitem.select(key, "l_partkey").distinct().groupBy(key).agg(F.count("l_partkey").alias("e"))
    p = stats.percentiles(t.lineitem, [key], "l_quantity", {"lo": ("cont", 0.48), "hi": ("cont", 0.52)})
    rows = guess.unionByName(exact, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)
    out = rows.groupBy(key).agg(*[F.max(c).alias(c) for c in ("a", "m", "e", "lo", "hi")])  # one row each
    return out.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("distinct_fits"), F.col("m").between(F.col("lo"), F.col("hi")).alias("median_fits"))


# --- drift between two halves of a table, over fixed bins

_BINS = "least(floor(value / 10), 9)::INT"
_DRIFT = f"""
WITH b AS (SELECT {_BINS} AS bin, count(*) FILTER (WHERE event_id % 2 = 0)::DOUBLE AS a, count(*) FILTER (WHERE event_id % 2 = 1)::DOUBLE AS b FROM events GROUP BY 1),
p AS (SELECT bin, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM b),
c AS (SELECT *, sum(p) OVER (ORDER BY bin) AS cp, sum(q) OVER (ORDER BY bin) AS cq, (p + q) / 2 AS m FROM p)
SELECT round(max(abs(cp - cq)), 8) AS ks, round(sum(abs(cp - cq)), 8) AS wasserstein,
  round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 8) AS js FROM c"""


@query("o_drift", _DRIFT)
def o_drift(t):
    from ..operators.stats import binned_drift

    rows = t.events.withColumn("bin", F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int"))
    out = binned_drift(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "bin")
    return out.select(*[F.round(c, 8).alias(c) for c in ("ks", "wasserstein", "js")])


# --- geography


def _points(t):
    return t.customer.select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("x"), (F.col("c_custkey") % 180 - 90).cast("double").alias("y"))


@query("m_geo_predicates", """
WITH p AS (SELECT c_custkey, (c_custkey % 360 - 180)::DOUBLE AS x, (c_custkey % 180 - 90)::DOUBLE AS y FROM customer)
SELECT c_custkey, x <= 20 AND x + 10 >= 5 AND y <= 20 AND y + 10 >= 5 AS meets, x BETWEEN 0 AND 30 AND y BETWEEN 0 AND 30 AS in_box, 16 AS corners, 'POINT(' || x || ' ' || y || ')' AS wkt, x AS back FROM p""")
def m_geo_predicates(t):
    p = _points(t)
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 10).alias("x2"), (F.col("y") + 10).alias("y2"))
    other = geo.envelope(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(a).alias("y")) for a in (5.0, 20.0)]))
    wkt = geo.as_text(F.col("x"), F.col("y"))
    p = p.withColumns({"box": box, "other": other, "wkt": wkt})
    return p.select("c_custkey", geo.boxes_intersect(F.col("box"), F.col("other")).alias("meets"), geo.point_in_bbox(F.col("x"), F.col("y"), F.lit(0), F.lit(0), F.lit(30), F.lit(30)).alias("in_box"),
                    F.size(geo.buffer(F.col("x"), F.col("y"), F.lit(2.0))).alias("corners"), "wkt", geo.from_text(F.col("wkt"))[0].x.alias("back"))


@query("m_geohash", "SELECT c_custkey, true AS near FROM customer")
def m_geohash(t):
    """Decoding a code of six letters comes back within its cell."""
    p = _points(t).withColumn("d", geo.geohash_decode(geo.geohash(F.col("x"), F.col("y"))))
    return p.select("c_custkey", ((F.abs(F.col("d.lon") - F.col("x")) <= 0.0055) & (F.abs(F.col("d.lat") - F.col("y")) <= 0.0028)).alias("near"))


@query("m_geo_circle", """
WITH p AS (SELECT c_custkey, radians((c_custkey % 360 - 180)::DOUBLE) AS x, radians((c_custkey % 180 - 90)::DOUBLE) AS y FROM customer)
SELECT c_custkey, 2 * 6371000 * asin(sqrt(pow(sin(y / 2), 2) + cos(y) * pow(sin(x / 2), 2))) <= 5000500 AS inside FROM p""")
def m_geo_circle(t):
    return _points(t).select("c_custkey", geo.point_in_circle(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(5000500.0)).alias("inside"))


# --- search syntax


@query("m_tsquery", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, (list_contains(t, 'the') AND NOT list_contains(t, 'thon')) OR list_contains(t, 'der') AS q, list_contains(t, 'the') AND list_contains(t, 'and') AS plain,
  (list_contains(t, 'the') AND NOT list_contains(t, 'of')) OR list_contains(t, 'les') AS web FROM d""")
def m_tsquery(t):
    d = tables.checkpoint(t.documents.select("doc_id", fulltext.tokens(F.col("text")).alias("t")))
    return d.select("doc_id", fulltext.to_tsquery("(the & !thon) | der", F.col("t")).alias("q"), fulltext.plainto_tsquery("The, and", F.col("t")).alias("plain"),
                    fulltext.websearch_to_tsquery("the -of or les", F.col("t")).alias("web"))


@query("m_ngram_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%idge%'")
def m_ngram_like(t):
    """LIKE '%x%' through an index of three-letter runs, confirmed on the text."""
    index = tables.checkpoint(fulltext.trigrams(t.part, "p_partkey", "p_name"))
    return fulltext.like_by_trigrams(index, t.part, "p_partkey", "p_name", "idge").select("p_partkey")


# --- vectors


@query("m_similarity_matrix", """
WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL), v AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 5) AS s FROM v a, v b""")
def m_similarity_matrix(t):
    """Cosine similarity of the class means: a matrix of the number of classes."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = parts.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    a, b = parts.toDF("a", "i", "xa"), parts.toDF("b", "i", "xb")
    dots = a.join(b, "i").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("d"))
    return dots.join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b").select("a", "b", F.round(F.col("d") / (F.col("na") * F.col("nb")), 5).alias("s"))


@query("m_ivf_recall", "SELECT true AS found")
def m_ivf_recall(t):
    """Five of eight lists hold most of the ten nearest."""
    model, rows = vector_search.ivf(t.embeddings, "vec_id", "embedding", 8)
    q = t.embeddings.filter("vec_id = 0").select("embedding").head()[0]
    near = vector_search.ivf_search(model, rows, "vec_id", "embedding", q, 10, 5).select("vec_id")
    exact = vector_search.knn(t.embeddings, "vec_id", "embedding", q, 10).select("vec_id")
    return near.join(exact, "vec_id").agg((F.count("*") >= 6).alias("found"))


# --- streams


@query("n_late", """
WITH w AS (SELECT max(ts) - INTERVAL '1 day' AS a FROM events WHERE event_id % 2 = 0), z AS (SELECT max(ts) - INTERVAL '1 day' AS b FROM events),
k AS (SELECT event_id, date_trunc('day', ts) AS d, ts FROM events)
SELECT d::TIMESTAMP AS window_start, count(*) AS n FROM k, w, z WHERE (event_id % 4 <> 3 OR d + INTERVAL '1 day' > a) AND d + INTERVAL '1 day' <= b GROUP BY 1""")
def n_late(t):
    """Three files in turn. The watermark that the first sets drops rows of the third whose day it
    has closed (a batch takes rows as late by the watermark before its own); a day is put out once
    it is closed."""
    path = f"{tables.shared_dir(t.spark)}/sparkwell/late-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in ("event_id % 2 = 0", "event_id % 4 = 1", "event_id % 4 = 3"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = windows.file_stream(t.spark, path, rows.schema, per_trigger=1)
    out = windows.aggregate(stream, "ts", [], [F.count("*").alias("n")], "1 day", late="1 day")
    return _ntz(windows.drain(out, f"late_{uuid.uuid4().hex}", "append"), "window_start").select("window_start", "n")


@query("n_change_apply", "SELECT s_suppkey, s_acctbal + CASE WHEN s_suppkey % 4 = 1 THEN 5 ELSE 0 END AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0")
def n_change_apply(t):
    """Change events from a stream, applied batch by batch to a snapshot table."""
    spark, root = t.spark, f"{tables.shared_dir(t.spark)}/sparkwell/changes-{uuid.uuid4().hex}"
    base = t.supplier.select("s_suppkey", "s_acctbal")
    table = tables.SnapshotTable(spark, f"{root}/table")
    table.write(base)
    base.filter("s_suppkey % 4 < 2").select(
        "s_suppkey", (F.col("s_acctbal") + 5).alias("s_acctbal"), F.when(F.col("s_suppkey") % 4 == 0, "d").otherwise("u").alias("op"), F.lit(1).alias("at")
    ).write.parquet(f"{root}/events")
    stream = windows.file_stream(spark, f"{root}/events", spark.read.parquet(f"{root}/events").schema)
    windows.apply_each_batch(stream, lambda b, i: table.write(tables.apply_changes(table.read(), b, ["s_suppkey"], "at")), f"{root}/state")
    return table.read()


# --- small scalars

sql("j_now", "SELECT count(*) AS past FROM events WHERE ts <= now() AND current_date() >= DATE '2020-01-01'",
    "SELECT count(*) AS past FROM events WHERE ts <= now()::TIMESTAMP AND current_date >= DATE '2020-01-01'")
sql("l_empty", "SELECT p_partkey, size(filter(array(p_size), x -> x > 25)) = 0 AS is_empty, size(filter(array(p_size), x -> x > 25)) > 0 AS not_empty FROM part",
    "SELECT p_partkey, p_size <= 25 AS is_empty, p_size > 25 AS not_empty FROM part")
sql("f_collated_like", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) LIKE 'b%' AND c_mktsegment COLLATE UNICODE_CI >= 'AUTOMOBILE'",
    "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) LIKE 'b%' AND lower(c_mktsegment) >= 'automobile'")


@query("i_gcd", "SELECT l_orderkey, l_linenumber, gcd(l_partkey, l_suppkey) AS g FROM lineitem")
def i_gcd(t):
    from ..functions.numbers import gcd

    return t.lineitem.select("l_orderkey", "l_linenumber", gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g"))


@query("i_fibonacci", "WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 24) SELECT n_nationkey, a AS fib FROM nation JOIN f ON n = n_nationkey")
def i_fibonacci(t):
    from ..functions.numbers import fibonacci

    return t.nation.select("n_nationkey", fibonacci(F.col("n_nationkey")).alias("fib"))


@query("h_ipv6_number", "SELECT c_custkey, '20010db8' || repeat('0', 20) || lpad(lower(to_hex(c_custkey % 60000)), 4, '0') AS digits FROM customer")
def h_ipv6_number(t):
    from ..functions.numbers import ipv6_digits

    ip = F.concat(F.lit("2001:DB8::"), F.hex(F.col("c_custkey") % 60000))
    return t.customer.select("c_custkey", ipv6_digits(ip).alias("digits"))


@query("h_macaddr", "SELECT s_suppkey, 'aa:bb:cc:00:' || substr(lpad(lower(to_hex(s_suppkey % 60000)), 4, '0'), 1, 2) || ':' || substr(lpad(lower(to_hex(s_suppkey % 60000)), 4, '0'), 3, 2) AS mac FROM supplier")
def h_macaddr(t):
    from ..functions.numbers import macaddr

    return t.supplier.select("s_suppkey", macaddr(F.concat(F.lit("AA-BB-CC-00"), F.lpad(F.hex(F.col("s_suppkey") % 60000), 4, "0"))).alias("mac"))


@query("k_pretty", "SELECT n_nationkey, '{' || chr(10) || '  \"a\" : ' || n_nationkey || ',' || chr(10) || '  \"b\" : \"' || n_name || '\"' || chr(10) || '}' AS j FROM nation")
def k_pretty(t):
    return t.nation.select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")), {"pretty": "true"}).alias("j"))


@query("k_remove_match", "SELECT n_nationkey, '{\"b\":{\"c\":' || n_regionkey || '}}' AS rest, n_regionkey > 2 AS hit FROM nation")
def k_remove_match(t):
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("a"), F.struct(F.col("n_regionkey").alias("c")).alias("b")))
    rest = F.regexp_replace(jsonpath.json_remove(doc, ["a"]), " ", "")
    return t.nation.select("n_nationkey", rest.alias("rest"), (F.get_json_object(doc, "$.b.c").cast("int") > 2).alias("hit"))


@query("b_masking_kinds", """
SELECT c_custkey, regexp_replace(c_name, '[0-9]', '9', 'g') AS shape, 'REDACTED' AS constant, floor(c_acctbal / 100) * 100 AS rounded, sha256('s' || c_name) AS token FROM customer""")
def b_masking_kinds(t):
    return t.customer.select("c_custkey", F.regexp_replace("c_name", "[0-9]", "9").alias("shape"), F.lit("REDACTED").alias("constant"),
                             (F.floor(F.col("c_acctbal") / 100) * 100).cast("double").alias("rounded"), masking.hashed(F.col("c_name"), "s").alias("token"))


@query("o_validate_kinds", """
SELECT 'custkey_type' AS rule, count(*) AS passed, 0::BIGINT AS failed FROM customer UNION ALL
SELECT 'phone', count(*) FILTER (WHERE regexp_matches(c_name, '^\\+?[0-9 ().-]{7,20}$')), count(*) FILTER (WHERE NOT regexp_matches(c_name, '^\\+?[0-9 ().-]{7,20}$')) FROM customer UNION ALL
SELECT 'expression', count(*) FILTER (WHERE c_acctbal > 0), count(*) FILTER (WHERE c_acctbal <= 0) FROM customer""".replace("\\\\", "\\"))
def o_validate_kinds(t):
    from ..operators import dataquality as dq

    return dq.validate(t.customer, {"custkey_type": dq.rule("type", "c_custkey", "bigint"), "phone": dq.rule("phone", "c_name"), "expression": dq.rule("expression", "c_acctbal", "c_acctbal > 0")})


@query("a_dedup_table", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def a_dedup_table(t):
    keep = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey"), "o_orderkey").alias("r"))
    return keep.select("o_custkey", "r.o_orderkey")


@query("a_upsert_keep", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 5")
def a_upsert_keep(t):
    """INSERT .. ON CONFLICT DO NOTHING."""
    base = t.nation.select("n_nationkey", "n_name")
    new = base.withColumn("n_name", F.lit("x")).unionByName(base.filter("n_nationkey < 5").withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast(base.schema[0].dataType)))
    return dml.upsert(base, new, ["n_nationkey"], do_nothing=True)
