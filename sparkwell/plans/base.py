"""The registry of queries and the table loader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads that table of the folder; columns and filters are pushed down."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register ``f(t: Tables) -> DataFrame``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def run_sql(t: Tables, text: str) -> DataFrame:
    """Spark SQL over the tables it names, each as a view of this call only."""
    import re

    used = [n for n in TABLES if re.search(rf"\b{n}\b", text)]
    for n in used:
        getattr(t, n).createOrReplaceTempView(n)
    return t.spark.sql(text)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query that is SQL; without ``oracle`` the same text is its twin."""
    query(name, text if oracle is None else oracle)(lambda t: run_sql(t, text))
