from pyspark.sql import functions as F

from sparkwell.llm import sharding

SCHEMA = "doc_id long, text string"


def frame(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))


def test_append_compact_read(spark, tmp_path):
    df = frame(spark, 0, 4000)
    d = sharding.Dataset(spark, f"file://{tmp_path}/d", df.schema, target_bytes=1 << 20)
    assert d.read().count() == 0 and d.version() == 0
    d.append(df.withColumn("_a", F.col("doc_id") % 5), "_a")
    assert len(d.runs()) == 5
    v = d.append(frame(spark, 4000, 4010).coalesce(1))
    before = sorted(map(tuple, d.read().select("doc_id", "text").collect()))
    last = d.compact()
    assert last > v and len(d.runs()) < 6
    assert sorted(map(tuple, d.read().select("doc_id", "text").collect())) == before == sorted(map(tuple, frame(spark, 0, 4010).collect()))
    assert d.read(v).count() == 4010  # the old version is still there
    assert d.vacuum() > 0 and d.read().count() == 4010
    assert max(r["tier"] for r in d.runs()) >= 1


def test_only_one_writer_commits_a_version(spark, tmp_path):
    df = frame(spark, 0, 10)
    d = sharding.Dataset(spark, f"file://{tmp_path}/d", df.schema)
    d.append(df)
    runs = d.runs()
    assert d._commit(1, runs) and not d._commit(1, [])
    assert d.runs(2) == runs
    d.append(df)
    assert d.version() == 3 and d.read().count() == 20


def test_nulls_empty_and_extra(spark, tmp_path):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 200_000)], SCHEMA).withColumn("extra", F.lit(None).cast("int"))
    d = sharding.Dataset(spark, f"file://{tmp_path}/d", df.schema)
    d.append(df)
    d.append(df.limit(0))
    assert d.read().count() == 4 and d.read().columns == ["doc_id", "text", "extra", "shard", "file"]


def test_tiers_group_similar_sizes(spark, tmp_path):
    d = sharding.Dataset(spark, f"file://{tmp_path}/d", frame(spark, 0, 1).schema)
    runs = [{"name": str(i), "files": ["f"], "bytes": b, "tier": 0} for i, b in enumerate((10, 11, 12, 100, 110, 1000))]
    assert [[r["bytes"] for r in t] for t in d.tiers(runs)] == [[10, 11, 12], [100, 110], [1000]]
