"""The Bloom filter: nothing missed, few false finds, one row a value whatever the number of hashes."""

from pyspark.sql import functions as F

from sparkwell.operators import sketches


def test_bloom_filter(spark):
    inside = spark.range(30_000).select((F.col("id") * 7).alias("k"))
    outside = spark.range(30_000).select((F.col("id") * 7 + 3).alias("k"))
    made = sketches.bloom(inside, "k", 30_000)
    assert made[1] > 100
    twice = sketches.bloom_maybe(made, inside.unionByName(inside), "k")
    assert twice.filter("maybe").count() == twice.count() == 30_000
    assert 0.003 < sketches.bloom_maybe(made, outside, "k").agg(F.avg(F.col("maybe").cast("double"))).head()[0] < 0.013


def test_bloom_filter_of_few_values_and_nulls(spark):
    some = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    made = sketches.bloom(some, "k", 3)
    got = {r.k: r.maybe for r in sketches.bloom_maybe(made, spark.createDataFrame([("x",), (None,), ("z",)], "k string"), "k").collect()}
    assert got == {"x": True, None: True, "z": False}
    none = sketches.bloom(some.filter("false"), "k", 0)
    assert [r.maybe for r in sketches.bloom_maybe(none, some, "k").collect()] == [False] * 3


def test_bloom_filter_asks_for_a_value_in_one_row(spark):
    """A row for each bit of each value was exchanged three times."""
    rows = spark.range(100).select(F.col("id").alias("k"))
    plan = sketches.bloom_maybe(sketches.bloom(rows, "k", 100), rows, "k")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("explode(") <= 1
