"""Row versions with a span of validity [from, to): time travel and update from another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def versions(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """``rows`` with valid_from and valid_to (null: still valid): each version of a key ends
    where its next begins."""
    return rows.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(W.partitionBy(*key).orderBy(at))})


def as_of(v: DataFrame, when: Column) -> DataFrame:
    return v.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def from_to(v: DataFrame, start: Column, end: Column) -> DataFrame:
    """Valid at some time in [start, end)."""
    return v.filter((F.col("valid_from") < end) & (F.col("valid_to").isNull() | (F.col("valid_to") > start)))


def between(v: DataFrame, start: Column, end: Column) -> DataFrame:
    """Valid at some time in [start, end], the end included."""
    return v.filter((F.col("valid_from") <= end) & (F.col("valid_to").isNull() | (F.col("valid_to") > start)))


def update_from(target: DataFrame, source: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """``values`` (Columns over the target and ``s_<col>`` of the source) in the rows of ``target``
    that have a row of ``source`` with their key; ``source`` has at most one row a key."""
    renamed = source.select(*key, *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in key], F.lit(True).alias("s_hit"))
    hit = target.join(renamed, key, "left")
    return hit.select(*[F.when(F.col("s_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])
