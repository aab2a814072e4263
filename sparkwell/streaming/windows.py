"""Windowed and keyed aggregates on streams. Times are TIMESTAMP; late rows past the watermark
are dropped, as Spark does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None, **options) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema).options(**options)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """(topic, partition, offset, key, value, timestamp, headers); needs the Kafka package."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true").options(**options).load()


def aggregate(stream: DataFrame, ts: str, keys: list[str], aggs: list[Column], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones; the watermark allows ``late`` (one window by default)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, late or size).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(stream: DataFrame, ts: str, keys: list[str], aggs: list[Column], gap: str, late: str | None = None) -> DataFrame:
    out = stream.withWatermark(ts, late or gap).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def deduplicate(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Exactly-once ingest by key: state is held no longer than the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All there is now, as a table in the shared folder: each micro-batch is a folder by its
    number, written anew if it is repeated; of a complete stream the last one holds all."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/sparkwell/{name}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/{number}")
        done.append(number)

    apply_each_batch(stream, write, f"{root}/state", mode)
    parts = done[-1:] if mode == "complete" else done
    rows = spark.read.schema(stream.schema)
    return rows.parquet(*[f"{root}/rows/{i}" for i in dict.fromkeys(parts)]) if parts else spark.createDataFrame([], stream.schema)


def to_table(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append"):
    """A file sink with exactly-once files, run until the source is drained."""
    q = stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def apply_each_batch(stream: DataFrame, apply, checkpoint: str, mode: str = "append"):
    """``apply(batch, id)`` for every micro-batch, for upserts and change application."""
    q = stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
