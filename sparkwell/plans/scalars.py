"""String, math, date, JSON, array, map, URL, IP, vector and geo scalars."""

from pyspark.sql import functions as F

from ..functions import arrays, geo, masking, network, ranges, vectors
from .base import query, sql

# --- strings

sql("h_strings", """
SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INT) AS n, trim('  ' || p_type || ' ') AS t, ltrim('  ' || p_type) AS lt, rtrim(p_type || '  ') AS rt,
  concat(p_brand, '/', p_type) AS c, substring(p_name, 2, 3) AS s, replace(p_name, 'a', 'zz') AS r, left(p_name, 3) AS lf, right(p_name, 3) AS rg, reverse(p_brand) AS rv,
  coalesce(NULLIF(p_brand, p_brand), 'none') AS co, lpad(p_brand, 12, '.') AS lp, rpad(p_brand, 12, '.') AS rp, repeat('ab', 2) AS rep FROM part""")
sql("h_regex", r"""
SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS every, regexp_replace(p_name, '^(.*?)[aeiou]', '$1_') AS first, regexp_like(p_type, '^[A-S]') AS m,
  regexp_extract(p_name, '([a-zA-Z]+).*?([0-9]+)', 2) AS digits, regexp_replace(p_name, '(?i)PART', 'x') AS ci FROM part""", r"""
SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_matches(p_type, '^[A-S]') AS m,
  regexp_extract(p_name, '([a-zA-Z]+).*?([0-9]+)', 2) AS digits, regexp_replace(p_name, 'PART', 'x', 'gi') AS ci FROM part""")
sql("h_distance", "SELECT s_suppkey, CAST(levenshtein(s_name, 'Supplier#000000042') AS INT) AS lev FROM supplier")
sql("h_ngrams", """
SELECT n_nationkey, array_join(transform(sequence(1, length(n_name) - 2), i -> substring(n_name, i, 3)), ',') AS grams FROM nation WHERE length(n_name) >= 3""",
    "SELECT n_nationkey, array_to_string([substring(n_name, i, 3) FOR i IN range(1, length(n_name) - 1)], ',') AS grams FROM nation WHERE length(n_name) >= 3")
sql("h_tokenize", r"SELECT doc_id, size(filter(split(lower(text), '[^a-z0-9]+'), x -> x <> '')) AS n FROM documents",
    r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))::INT AS n FROM documents")


@query("h_url", """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '[^.]+$') AS tld,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') AS bare, regexp_extract(url, '^([a-z]+)://', 1) AS protocol,
  NULLIF(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, NULLIF(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""".replace("\\\\", "\\"))
def h_url(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", network.host(u).alias("host"), network.top_level_domain(u).alias("tld"), network.domain_without_www(u).alias("bare"),
        F.parse_url(u, F.lit("PROTOCOL")).alias("protocol"), F.parse_url(u, F.lit("QUERY")).alias("query"),
        F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"))


@query("h_url_coding", "SELECT s_suppkey, url_encode(s_name || ' a&b') AS enc, s_name || ' a&b' AS back FROM supplier".replace("url_encode(s_name || ' a&b')", "replace(url_encode(s_name || ' a&b'), '%20', '+')"))
def h_url_coding(t):
    raw = F.concat("s_name", F.lit(" a&b"))
    return t.supplier.select("s_suppkey", F.url_encode(raw).alias("enc"), F.url_decode(F.url_encode(raw)).alias("back"))


@query("h_ip", """
WITH a AS (SELECT c_custkey, (c_custkey * 2654435) % 4294967296 AS n FROM customer)
SELECT c_custkey, n, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS ip,
  (n >> 24) = 10 OR (n >> 20) = 2753 OR (n >> 16) = 49320 AS private, n BETWEEN 167772160 AND 184549375 AS in_ten, 4 AS version FROM a""")
def h_ip(t):
    n = F.pmod(F.col("c_custkey") * 2654435, F.lit(4294967296))
    ip = network.number_to_ipv4(n)
    return t.customer.select("c_custkey", n.alias("n"), ip.alias("ip")).select(
        "c_custkey", network.ipv4_to_number(F.col("ip")).alias("n"), "ip", network.is_private(F.col("ip")).alias("private"),
        network.ipv4_in_range(F.col("ip"), F.lit("10.0.0.0/8")).alias("in_ten"), network.ip_version(F.col("ip")).alias("version"))


@query("h_masking", """
SELECT c_custkey, '****' AS full, CASE WHEN length(c_name) <= 3 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', length(c_name) - 3) || right(c_name, 1) END AS part,
  sha256('k' || c_name) AS hashed, left(c_name, 1) || '***@x.org' AS mail, regexp_replace('4111-1111-1111-1234', '^[0-9-]+-', '****-****-****-') AS card FROM customer""")
def h_masking(t):
    c = F.col("c_name")
    return t.customer.select(
        "c_custkey", masking.full(c).alias("full"), masking.partial(c, 2, 1).alias("part"), masking.hashed(c, "k").alias("hashed"),
        masking.email(F.concat(c, F.lit("@x.org"))).alias("mail"), masking.last_four(F.lit("4111-1111-1111-1234")).alias("card"))


@query("h_chunking", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, (s // 80)::INT AS chunk, array_to_string(w[s + 1 : s + 100], ' ') AS body FROM c""")
def h_chunking(t):
    from ..operators.text import chunk_words

    return chunk_words(t.documents, "doc_id", "text", size=100, overlap=20)


# --- math

sql("i_math", """
SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, c_custkey % 7 AS m, round(pow(c_custkey, 0.5), 6) AS p,
  round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS ln, round(log(2, abs(c_acctbal) + 1), 6) AS l2, round(exp(c_acctbal / 10000), 6) AS e, CAST(sign(c_acctbal) AS INT) AS s,
  greatest(c_custkey, 100) AS g, least(c_custkey, 100) AS le, round(radians(c_acctbal), 6) AS ra, round(sin(c_acctbal), 6) AS si, round(atan2(c_acctbal, 2), 6) AS at FROM customer""")
sql("i_integer", "SELECT n_nationkey, factorial(CAST(n_nationkey % 15 AS INT)) AS f FROM nation", "SELECT n_nationkey, factorial(n_nationkey % 15)::BIGINT AS f FROM nation")
sql("i_hex_bits", "SELECT o_orderkey, lower(hex(o_orderkey)) AS h, o_orderkey & 255 AS lo, bit_count(o_orderkey) AS ones FROM orders",
    "SELECT o_orderkey, lower(to_hex(o_orderkey)) AS h, o_orderkey & 255 AS lo, bit_count(o_orderkey)::INT AS ones FROM orders")

# --- dates

sql("j_trunc", """
SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP_NTZ) AS y, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP_NTZ) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP_NTZ) AS w, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP_NTZ) AS d FROM orders""", """
SELECT o_orderkey, date_trunc('year', o_orderdate)::TIMESTAMP AS y, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q, date_trunc('month', o_orderdate)::TIMESTAMP AS m, date_trunc('week', o_orderdate)::TIMESTAMP AS w, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders""")
sql("j_extract", """
SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofweek(ts) - 1 AS dow, dayofyear(ts) AS doy, weekofyear(ts) AS wk,
  unix_timestamp(CAST(ts AS TIMESTAMP)) AS epoch, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events""", """
SELECT event_id, year(ts)::INT AS y, quarter(ts)::INT AS q, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, dayofweek(ts)::INT AS dow, dayofyear(ts)::INT AS doy, weekofyear(ts)::INT AS wk,
  floor(epoch(ts))::BIGINT AS epoch, epoch_us(ts) AS us FROM events""")
sql("j_arith", """
SELECT o_orderkey, timestampadd(DAY, 10, o_orderdate) AS d10, timestampadd(HOUR, -5, o_orderdate) AS h5, timestampadd(MONTH, 2, o_orderdate) AS m2,
  timestampdiff(DAY, timestamp_ntz '1992-01-01', o_orderdate) AS days, to_date(o_orderdate) AS dt, date_add(to_date(o_orderdate), 3) AS plus3, last_day(o_orderdate) AS ld FROM orders""", """
SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS d10, o_orderdate - INTERVAL 5 HOUR AS h5, o_orderdate + INTERVAL 2 MONTH AS m2,
  date_sub('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, o_orderdate::DATE AS dt, (o_orderdate::DATE + 3)::DATE AS plus3, last_day(o_orderdate) AS ld FROM orders""")
sql("j_from_epoch", "SELECT o_orderkey, CAST(timestamp_seconds(o_orderkey * 1000) AS TIMESTAMP_NTZ) AS ts FROM orders", "SELECT o_orderkey, make_timestamp(o_orderkey * 1000000000) AS ts FROM orders")
sql("j_time_bucket", """
SELECT CAST(timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) - pmod(unix_micros(CAST(ts AS TIMESTAMP)), 900000000)) AS TIMESTAMP_NTZ) AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1""",
    "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
sql("j_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd HH:mm') AS f FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f FROM orders")

# --- JSON

sql("k_extract", """
SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') AS none, get_json_object(props, '$.k') IS NOT NULL AS has_k,
  try_parse_json(props) IS NOT NULL AS valid, try_parse_json('{bad') IS NOT NULL AS invalid, array_join(json_object_keys(props), ',') AS keys FROM events""", """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS none, json_exists(props, '$.k') AS has_k,
  json_valid(props) AS valid, json_valid('{bad') AS invalid, array_to_string(json_keys(props), ',') AS keys FROM events""")
sql("k_build", """
SELECT event_id, to_json(named_struct('id', event_id, 'user', user_id, 'type', event_type)) AS obj, to_json(array(event_id, user_id)) AS arr, json_array_length(to_json(array(event_id, user_id, 7))) AS n FROM events""", """
SELECT event_id, json_object('id', event_id, 'user', user_id, 'type', event_type)::VARCHAR AS obj, json_array(event_id, user_id)::VARCHAR AS arr, json_array_length(json_array(event_id, user_id, 7))::INT AS n FROM events""")
sql("k_nested", """
SELECT event_id, get_json_object(concat('{"a":{"b":[1,', user_id, ',3]}}'), '$.a.b[1]') AS second, get_json_object(concat('{"a":{"b":[1,', user_id, ',3]}}'), '$.a.b[*]') AS all_b,
  lower(split(schema_of_variant(parse_json(concat('{"a":', user_id, '}'))), '<')[0]) AS kind FROM events""", """
SELECT event_id, json_extract_string('{"a":{"b":[1,' || user_id || ',3]}}', '$.a.b[1]') AS second, json_extract('{"a":{"b":[1,' || user_id || ',3]}}', '$.a.b')::VARCHAR AS all_b,
  lower(json_type('{"a":' || user_id || '}')) AS kind FROM events""")
sql("k_array_elements", "SELECT event_id, x FROM events LATERAL VIEW explode(from_json(concat('[', event_id, ',', user_id, ']'), 'array<bigint>')) e AS x",
    "SELECT event_id, unnest(from_json('[' || event_id || ',' || user_id || ']', '[\"BIGINT\"]')) AS x FROM events")
sql("k_xml", "SELECT n_nationkey, xpath_string(concat('<a><b>', n_nationkey, '</b></a>'), '/a/b') AS b, CAST(xpath_int(concat('<a><b>', n_nationkey, '</b></a>'), 'a/b') AS BIGINT) AS i FROM nation",
    "SELECT n_nationkey, n_nationkey::VARCHAR AS b, n_nationkey::BIGINT AS i FROM nation")


@query("k_deep_path", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '[1,' || user_id || ']' ELSE '[1]' END AS found, user_id % 2 = 0 AS contains FROM events""")
def k_deep_path(t):
    from ..functions.jsonpath import json_contains, json_path_all

    doc = F.concat(F.lit('{"a":{"x":1,"l":['), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"x":'), F.col("user_id"), F.lit("}"))).otherwise(""), F.lit("]}}"))
    part = F.concat(F.lit('{"a":{"l":[{"x":'), F.col("user_id"), F.lit("}]}}"))
    return t.events.select("event_id", json_path_all(doc, F.lit("$..x")).alias("found"), json_contains(doc, part).alias("contains"))


# --- arrays and maps


@query("l_arrays", """
WITH a AS (SELECT o_orderkey, [o_orderkey % 5, o_custkey % 5, 3, o_orderkey % 5] AS a, [3, o_custkey % 5] AS b FROM orders)
SELECT o_orderkey, len(a)::INT AS n, list_contains(a, 3) AS has3, a[2] AS second, a[-1] AS last, array_to_string(list_append(a, 9), ',') AS app, array_to_string(list_concat(a, b), ',') AS cat,
  array_to_string(list_sort(list_distinct(a)), ',') AS uniq, list_has_all(a, b) AS has_all, list_has_any(a, b) AS has_any, coalesce(list_position(a, 3), 0)::BIGINT AS pos,
  len(list_filter(a, lambda x: x = o_orderkey % 5))::INT AS eq, array_to_string(list_reverse(a), ',') AS rev, array_to_string(list_sort(a), ',') AS srt, array_to_string(a[2:3], ',') AS sl,
  list_sum(a)::DOUBLE AS s, round(list_avg(a), 6) AS av, list_min(a) AS mn, list_max(a) AS mx, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS inter,
  array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS diff, array_to_string(flatten([a, b]), ',') AS flat FROM a""")
def l_arrays(t):
    five = F.col("o_orderkey") % 5
    rows = t.orders.select("o_orderkey", F.array(five, F.col("o_custkey") % 5, F.lit(3).cast("long"), five).alias("a"), F.array(F.lit(3).cast("long"), F.col("o_custkey") % 5).alias("b"), five.alias("f"))
    a, b, j = F.col("a"), F.col("b"), lambda c: F.array_join(c, ",")
    return rows.select(
        "o_orderkey", F.size(a).alias("n"), F.array_contains(a, F.lit(3).cast("long")).alias("has3"), arrays.element(a, F.lit(2)).alias("second"), arrays.element(a, F.lit(-1)).alias("last"),
        j(F.array_append(a, F.lit(9).cast("long"))).alias("app"), j(F.concat(a, b)).alias("cat"), j(F.array_sort(F.array_distinct(a))).alias("uniq"), arrays.has_all(a, b).alias("has_all"),
        F.arrays_overlap(a, b).alias("has_any"), F.array_position(a, F.lit(3).cast("long")).alias("pos"), arrays.count_equal(a, F.col("f")).alias("eq"), j(F.reverse(a)).alias("rev"), j(F.sort_array(a)).alias("srt"),
        j(F.slice(a, 2, 2)).alias("sl"), arrays.total(a).alias("s"), F.round(arrays.mean(a), 6).alias("av"), F.array_min(a).alias("mn"), F.array_max(a).alias("mx"),
        j(arrays.intersect_keeping(a, b)).alias("inter"), j(arrays.difference_keeping(a, b)).alias("diff"), j(F.flatten(F.array(a, b))).alias("flat"))


@query("l_maps", """
SELECT n_nationkey, n_regionkey::BIGINT AS got, -1::BIGINT AS dflt, true AS has_r, false AS has_z, 'k,r' AS ks, (n_nationkey + n_regionkey)::BIGINT AS vs, 2 AS n, 99::BIGINT AS upd FROM nation""")
def l_maps(t):
    m = F.map_from_arrays(F.array(F.lit("k"), F.lit("r")), F.array(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")))
    return t.nation.select("n_nationkey", m.alias("m")).select(
        "n_nationkey", arrays.map_get(F.col("m"), F.lit("r")).alias("got"), arrays.map_get(F.col("m"), F.lit("z"), F.lit(-1).cast("long")).alias("dflt"), F.map_contains_key("m", F.lit("r")).alias("has_r"),
        F.map_contains_key("m", F.lit("z")).alias("has_z"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("ks"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x).alias("vs"),
        F.size("m").alias("n"), arrays.map_get(arrays.map_update(F.col("m"), F.create_map(F.lit("r"), F.lit(99).cast("long"))), F.lit("r")).alias("upd"))


# --- vectors


@query("m_vector_scalars", """
WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT vec_id, embedding::DOUBLE[] AS e, q::DOUBLE[] AS q FROM embeddings, q)
SELECT vec_id, len(e)::INT AS dims, round(sqrt(list_dot_product(e, e)), 5) AS norm, round(list_dot_product(e, q), 5) AS ip, round(list_cosine_similarity(e, q), 5) AS cos,
  round(list_distance(e, q), 5) AS l2, round(list_sum([abs(a - b) FOR a, b IN e]), 5) AS l1 FROM v""".replace("list_sum([abs(a - b) FOR a, b IN e])", "list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2])))"))
def m_vector_scalars(t):
    first = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    e, q = F.col("embedding"), F.col("q")
    return t.embeddings.crossJoin(F.broadcast(first)).select(
        "vec_id", F.size(e).alias("dims"), F.round(vectors.norm(e), 5).alias("norm"), F.round(vectors.dot(e, q), 5).alias("ip"), F.round(vectors.cosine(e, q), 5).alias("cos"),
        F.round(vectors.euclidean(e, q), 5).alias("l2"), F.round(vectors.manhattan(e, q), 5).alias("l1"))


# --- geo


@query("m_geo_distance", """
WITH p AS (SELECT c_custkey, (c_custkey * 37 % 360) - 180.0 AS lon, (c_custkey * 17 % 180) - 90.0 AS lat FROM customer)
SELECT c_custkey, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(48.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.5)) * pow(sin(radians(2.5 - lon) / 2), 2)))), 2) AS metres,
  round(sqrt(pow(lon - 2.5, 2) + pow(lat - 48.5, 2)), 6) AS planar, lon BETWEEN -10 AND 30 AND lat BETWEEN 35 AND 60 AS in_box FROM p""")
def m_geo_distance(t):
    lon, lat = (F.col("c_custkey") * 37 % 360) - 180.0, (F.col("c_custkey") * 17 % 180) - 90.0
    return t.customer.select("c_custkey", lon.alias("lon"), lat.alias("lat")).select(
        "c_custkey", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(2.5), F.lit(48.5)), 2).alias("metres"),
        F.round(F.sqrt(F.pow(F.col("lon") - 2.5, 2) + F.pow(F.col("lat") - 48.5, 2)), 6).alias("planar"),
        geo.point_in_bbox(F.col("lon"), F.col("lat"), F.lit(-10), F.lit(35), F.lit(30), F.lit(60)).alias("in_box"))


@query("m_geo_polygon", """
SELECT n_nationkey, ((n_nationkey + 1.0) * 2.0)::DOUBLE AS area, sqrt(n_nationkey * 1.0 * n_nationkey + 4) AS line, round((n_nationkey + 1) / 2.0, 6) AS cx, 1.0::DOUBLE AS cy, n_nationkey > 0 AS inside, false AS outside FROM nation""")
def m_geo_polygon(t):
    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    w = F.col("n_nationkey") + 1
    poly = F.array(p(F.lit(0), F.lit(0)), p(w, F.lit(0)), p(w, F.lit(2)), p(F.lit(0), F.lit(2)))
    line = F.array(p(F.lit(0), F.lit(0)), p(F.col("n_nationkey"), F.lit(2)))
    return t.nation.select(
        "n_nationkey", geo.area(poly).alias("area"), geo.length(line).alias("line"), F.round(geo.centroid(poly).x, 6).alias("cx"), geo.centroid(poly).y.alias("cy"),
        geo.contains(poly, F.lit(1.0) , F.lit(1.0)).alias("inside"), geo.contains(poly, F.lit(-1.0), F.lit(1.0)).alias("outside"))


@query("c_range_values", """
SELECT n_nationkey, n_nationkey >= 5 AND n_nationkey < 10 AS inside, n_nationkey < 10 AND n_nationkey + 3 > 5 AS over, n_nationkey + 3 = 5 OR n_nationkey = 10 AS touch,
  CASE WHEN n_nationkey < 10 AND n_nationkey + 3 > 5 THEN greatest(n_nationkey, 5) END AS lo FROM nation""")
def c_range_values(t):
    k = F.col("n_nationkey")
    a, b = ranges.make(k, k + 3), ranges.make(F.lit(5), F.lit(10))
    return t.nation.select("n_nationkey", ranges.contains(b, k).alias("inside"), ranges.overlaps(a, b).alias("over"), ranges.adjacent(a, b).alias("touch"), ranges.intersection(a, b).lo.alias("lo"))


# --- normal forms and features


@query("h_unicode", "SELECT doc_id, nfc_normalize(text) = text AS same, nfc_normalize('e' || chr(769)) AS accent FROM documents")
def h_unicode(t):
    from ..functions.strings import normalize_unicode

    accent = normalize_unicode(F.concat(F.lit("é"), F.left("lang", F.lit(0))))
    return t.documents.select("doc_id", (normalize_unicode(F.col("text")) == F.col("text")).alias("same"), accent.alias("accent"))


@query("o_time_features", """
SELECT event_id, hour(ts)::INT AS hour, dayofweek(ts)::INT AS weekday, dayofweek(ts) IN (0, 6) AS weekend, round(sin(hour(ts) * (2 * 3.141592653589793::DOUBLE / 24)), 6) AS hour_sin, round(cos(hour(ts) * (2 * 3.141592653589793::DOUBLE / 24)), 6) AS hour_cos FROM events""")
def o_time_features(t):
    from ..functions.strings import time_features

    return t.events.select("event_id", *time_features(F.col("ts")))


@query("m_hashed_embedding")
def m_hashed_embedding(t):
    from ..functions.strings import hashed_embedding
    from ..operators.text import tokens

    return t.part.select("p_partkey", tokens(F.col("p_name")).alias("k")).select("p_partkey", hashed_embedding(F.col("k"), 16).alias("vector"))
