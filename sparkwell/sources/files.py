"""Files in and out by format or by extension, sampling, and foreign tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY_EXTENSION = {
    "parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc", "avro": "avro", "txt": "text", "text": "text", "xml": "xml"}


def format_of(uri: str) -> str:
    name = uri.rstrip("/").split("?")[0].rsplit("/", 1)[-1].lower()
    for end in (".gz", ".bz2", ".zst", ".snappy"):
        name = name.removesuffix(end)
    return BY_EXTENSION.get(name.rsplit(".", 1)[-1], "parquet")


def external(spark: SparkSession, uri: str, fmt: str | None = None, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Any path that Spark's file systems open (file, s3a, gs, abfs, hdfs): format by extension."""
    fmt = fmt or format_of(uri)
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    elif fmt in ("csv", "json"):
        r = r.option("inferSchema", "true")
    if fmt == "csv":
        r = r.option("header", options.pop("header", "true"))
        if uri.lower().rstrip("/").endswith(".tsv"):
            r = r.option("sep", "\t")
    return r.options(**options).load(uri)


def copy_from(spark: SparkSession, path: str, schema: str, fmt: str = "csv", delimiter: str = ",", header: bool = False, quote: str = '"',
              null: str = "", bad_rows: str = "fail") -> DataFrame:
    """COPY ... FROM. ``bad_rows``: fail, drop, or keep (in the column _corrupt)."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad_rows]
    fields = T.StructType.fromDDL(schema)
    if bad_rows == "keep":
        fields = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    r = spark.read.format(fmt).schema(fields).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt")
    if fmt == "csv":
        r = r.option("sep", delimiter).option("header", str(header).lower()).option("quote", quote).option("nullValue", null)
    return r.load(path)


def copy_to(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", partition_by: list[str] = (), **options) -> None:
    """COPY ... TO."""
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def to_arrow_file(df: DataFrame, path: str) -> None:
    """One Arrow IPC file of a result that fits the driver."""
    import pyarrow as pa

    table = df.toArrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)


def jdbc(spark: SparkSession, url: str, query_or_table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A foreign table; filters, columns, aggregates and limits are pushed to the server.
    ``partition``: column, lower, upper, number of reads."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    r = r.option("query", query_or_table) if " " in query_or_table.strip() else r.option("dbtable", query_or_table)
    if partition:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition):
            r = r.option(k, v)
    return r.load()


def sample(df: DataFrame, method: str, amount: float, seed: int = 0, key: str | None = None) -> DataFrame:
    """BERNOULLI and SYSTEM take ``amount`` percent of the rows, RESERVOIR ``amount`` rows,
    HASH ``amount`` percent of the values of ``key`` (the same rows in every run)."""
    method = method.upper()
    if method in ("BERNOULLI", "SYSTEM"):
        return df.sample(fraction=amount / 100.0, seed=seed)
    if method == "RESERVOIR":
        return df.orderBy(F.rand(seed)).limit(int(amount))
    if method == "HASH":
        return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(amount * 100))
    raise ValueError(method)
