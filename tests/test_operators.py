"""Small hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import arrays, geo, jsonpath, network, ranges, strings
from sparkwell.operators import dml, graph, joins, mergetree, timeseries
from sparkwell.sources import files, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("direction,want", [("backward", [5, 15, 25, 35]), ("forward", [15, 25, 35, None]), ("nearest", [5, 15, 25, 35])])
def test_asof_directions(spark, direction, want):
    left = spark.createDataFrame([("a", t) for t in (10, 20, 30, 40)], "k string, t long")
    right = spark.createDataFrame([("a", t, t) for t in (5, 15, 25, 35)], "k string, t long, v long")
    got = joins.asof_join(left, right, "t", ["k"], direction).orderBy("t").collect()
    assert [r["r_v"] for r in got] == want


def test_asof_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([("a", t) for t in (10, 20, 25, 100)], "k string, t long")
    right = spark.createDataFrame([("a", t) for t in (5, 15)], "k string, t long")
    got = joins.asof_join(left, right, "t", ["k"], tolerance=10).orderBy("t").collect()
    assert [r["r_t"] for r in got] == [5, 15, 15, None]


def test_asof_equal_times_and_nulls(spark):
    left = spark.createDataFrame([("a", 5), ("b", 5), (None, 5), ("a", None)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", None, 9)], "k string, t long, v long")
    got = {(r.k, r.t): r["r_v"] for r in joins.asof_join(left, right, "t", ["k"]).collect()}
    assert got == {("a", 5): 2, ("b", 5): None, (None, 5): None, ("a", None): None}


def test_range_join_matches_brute_force(spark):
    pts = spark.createDataFrame([(i, i * 0.7) for i in range(60)], "p int, x double")
    rng = spark.createDataFrame([(i, i * 3.0, i * 3.0 + i) for i in range(12)], "r int, lo double, hi double")
    want = sorted((i, j) for i in range(60) for j in range(12) if j * 3.0 <= i * 0.7 < j * 3.0 + j)
    assert rows(joins.range_join(pts, rng, "x", "lo", "hi", 4.0), "p", "r") == want


def test_merge_trees(spark):
    v = spark.createDataFrame([(1, 100, 1), (1, 200, 2), (2, 300, 1)], "k int, v int, ver int")
    assert rows(mergetree.replacing(v, ["k"], "ver"), "k", "v") == [(1, 200), (2, 300)]
    c = spark.createDataFrame([(1, 1, 1), (1, -1, 2), (2, 1, 3)], "k int, s int, o int")
    assert rows(mergetree.collapsing(c, ["k"], "s", "o"), "k", "s") == [(2, 1)]
    s = spark.createDataFrame([(1, 100), (1, 50), (2, 200), (3, 5), (3, -5)], "k int, v int")
    assert rows(mergetree.summing(s, ["k"], ["v"]), "k", "v") == [(1, 150), (2, 200)]


def test_time_series(spark):
    g = spark.createDataFrame([("a", 0, 10.0), ("a", 3000, 40.0)], "s string, ts long, v double")
    assert [r.v for r in timeseries.gap_fill(g, ["s"], "ts", "v", 1000).orderBy("ts").collect()] == pytest.approx([10, 20, 30, 40])
    r = spark.createDataFrame([("a", 0, 0.0), ("a", 1000, 10.0), ("a", 2000, 30.0)], "s string, ts long, v double")
    assert [x.rate for x in timeseries.rate(r, ["s"], "ts", "v").orderBy("ts").collect()] == [10.0, 20.0]
    line = spark.createDataFrame([("a", 1000 * i, 2.0 * i) for i in range(10)], "s string, ts long, v double")
    f = timeseries.forecast(line, ["s"], "ts", "v", 5).orderBy("ts").collect()
    assert len(f) == 5 and f[0].v == pytest.approx(20) and f[0].ts == 10000
    z = spark.createDataFrame([("a", i, 1000.0 if i == 50 else 10.0) for i in range(100)], "s string, ts long, v double")
    assert rows(timeseries.detect_anomalies(z, ["s"], "v", 3.0), "ts") == [(50,)]
    e = timeseries.exponential_moving_average(r, ["s"], "ts", "v", 0.5).orderBy("ts").collect()
    assert [x.ema for x in e] == [0.0, 5.0, 17.5]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 5.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    best = {r.node: (r.cost, r.path) for r in graph.shortest_path(e, "a").collect()}
    assert best["d"] == (4.0, ["a", "b", "c", "d"])
    assert rows(graph.bfs(e, "a", 2), "node", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert sorted(r.path for r in graph.all_paths(e, "a", "d", 4).collect()) == [["a", "b", "c", "d"], ["a", "c", "d"]]
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src int, dst int")
    comp = {r.node: r.component for r in graph.connected_components(chain).collect()}
    assert {comp[i] for i in range(21)} == {0} and comp[51] == 50
    assert rows(graph.stats(e), "nodes", "edges", "avg_degree") == [(4, 4, 2.0)]


def test_dml(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    s = spark.createDataFrame([(2, 200), (3, -1), (4, 400)], "k int, v int")
    assert rows(dml.merge(t, s, ["k"], delete_when=F.col("s_v") < 0), "k", "v") == [(1, 10), (2, 200), (4, 400)]
    assert rows(dml.upsert(t, s, ["k"], do_nothing=True), "k", "v") == [(1, 10), (2, 20), (3, 30), (4, 400)]
    assert rows(dml.update(t, F.col("k") > 1, {"v": F.lit(0)}), "k", "v") == [(1, 10), (2, 0), (3, 0)]
    assert rows(dml.delete_using(t, s, ["k"]), "k") == [(1,)]


def test_changes_and_snapshots(spark, tmp_path):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    log = spark.createDataFrame([(1, 11, "u", 1), (1, 12, "u", 2), (2, None, "d", 3), (3, 30, "c", 4)], "k int, v int, op string, at int")
    assert rows(tables.apply_changes(t, log, ["k"], "at"), "k", "v") == [(1, 12), (3, 30)]
    snap = tables.SnapshotTable(spark, f"file://{tmp_path}/t")
    assert snap.write(t) == 1 and snap.write(t, "append") == 2 and snap.write(t, "ignore") == 2
    assert snap.read(1).count() == 2 and snap.read().count() == 4
    with pytest.raises(ValueError):
        snap.write(t, "error")


def test_files(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1,a\nx,b\n3,c\n")
    path, ddl = f"file://{tmp_path}/bad.csv", "k int, s string"
    assert rows(files.copy_from(spark, path, ddl, bad_rows="drop"), "k") == [(1,), (3,)]
    kept = files.copy_from(spark, path, ddl, bad_rows="keep").collect()
    assert [r._corrupt for r in kept] == [None, "x,b", None]
    assert files.format_of("s3a://b/x.jsonl.gz") == "json" and files.format_of("/a/b/") == "parquet"


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        network.ipv4_to_number(F.lit("10.0.0.1")).alias("n"), network.ipv4_to_number(F.lit("10.0.0.256")).alias("bad"), network.ip_version(F.lit("::1")).alias("v6"),
        network.number_to_ipv4(F.lit(167772161)).alias("ip"), network.cidr_range(F.lit("10.1.2.3/24")).alias("c"),
        geo.geohash(F.lit(-5.6), F.lit(42.6), 5).alias("gh"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"),
        arrays.element(F.array(F.lit(1), F.lit(2)), F.lit(0)).alias("zero"),
        jsonpath.json_path_all(F.lit('{"a":[{"p":1},{"p":5}]}'), F.lit("$.a[?(@.p>2)].p")).alias("f"),
        jsonpath.json_path_all(F.lit('{"a":[1,2,3]}'), F.lit("$.a[0:2]")).alias("s"),
        jsonpath.json_remove(F.lit('{"a":{"b":1,"c":2}}'), ["a", "b"]).alias("rm")).head()
    assert (got.n, got.bad, got.v6, got.ip) == (167772161, None, 6, "10.0.0.1")
    assert (got.c.lo, got.c.hi) == (167838208, 167838463)
    assert got.gh == "ezs42" and got.d == pytest.approx(111194.93, abs=0.1) and got.zero is None
    assert (got.f, got.s, got.rm) == ("[5]", "[1,2]", '{"a":{"c":2}}')
    back = one.select(geo.geohash_decode(F.lit("ezs42"), 5).alias("p")).head().p
    assert back.lon == pytest.approx(-5.6, abs=0.03) and back.lat == pytest.approx(42.6, abs=0.03)


def test_ranges(spark):
    a, b = ranges.make(F.lit(1), F.lit(5)), ranges.make(F.lit(5), F.lit(9))
    got = spark.range(1).select(
        ranges.overlaps(a, b).alias("o"), ranges.adjacent(a, b).alias("t"), ranges.contains(a, F.lit(1)).alias("c1"), ranges.contains(a, F.lit(5)).alias("c5"),
        ranges.intersection(ranges.make(F.lit(1), F.lit(7)), b).alias("i")).head()
    assert (got.o, got.t, got.c1, got.c5) == (False, True, True, False) and (got.i.lo, got.i.hi) == (5, 7)


def test_time_features_keep_the_sign_of_zero(spark):
    hours = spark.range(24).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    got = hours.union(spark.sql("SELECT CAST(NULL AS timestamp)")).select(*strings.time_features(F.col("ts"))).collect()
    for r in got[:24]:
        angle = r.hour * (2 * math.pi / 24)
        assert repr((r.hour_sin, r.hour_cos)) == repr((round(math.sin(angle), 6), round(math.cos(angle), 6)))
    assert repr(got[18].hour_cos) == "-0.0" and got[24].hour_cos is None
