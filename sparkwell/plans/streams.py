"""Streaming queries over the events table as a file source, drained at once."""

import uuid

from pyspark.sql import functions as F

from ..streaming import windows
from .base import query


def _events(t):
    """The stream reads the folder of the table, or its one file through a glob."""
    spark = t.spark
    path = f"{t.sf_dir}/events.parquet"
    stream = windows.file_stream(spark, path if _is_dir(spark, path) else f"{t.sf_dir}/event*.parquet", t.events.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark, path) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _name() -> str:
    return f"stream_{uuid.uuid4().hex}"


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("n_tumbling", """
SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def n_tumbling(t):
    out = windows.aggregate(_events(t), "ts", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")], "1 hour")
    return _ntz(windows.drain(out, _name()), "window_start").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("n_sliding", """
SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - to_minutes(30 * k) AS window_start, count(*) AS n, max(value) AS top FROM events, range(2) r(k) GROUP BY 1""")
def n_sliding(t):
    out = windows.aggregate(_events(t), "ts", [], [F.count("*").alias("n"), F.max("value").alias("top")], "1 hour", "30 minutes")
    return _ntz(windows.drain(out, _name()), "window_start").select("window_start", "n", "top")


@query("n_session", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def n_session(t):
    out = windows.sessions(_events(t), "ts", ["user_id"], [F.count("*").alias("n")], "6 hours")
    return _ntz(windows.drain(out, _name()), "session_start", "session_end")


@query("n_stateful", """
SELECT user_id, count(*) AS n, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY user_id""")
def n_stateful(t):
    out = _events(t).groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))
    return windows.drain(out, _name())


@query("n_filter_project", "SELECT event_id, event_type, round(value * 2, 6) AS twice FROM events WHERE value > 50")
def n_filter_project(t):
    out = _events(t).filter("value > 50").select("event_id", "event_type", F.round(F.col("value") * 2, 6).alias("twice"))
    return windows.drain(out, _name(), "append")


@query("n_dedup", "SELECT DISTINCT event_id FROM events")
def n_dedup(t):
    twice = _events(t).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return windows.drain(windows.deduplicate(twice, "ts", ["event_id"], "1 hour").select("event_id"), _name(), "append")
