"""Merge-on-read tables: rows of a key are combined when read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replacing(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of each key the row of the highest version (of several, the greatest row)."""
    rest = [c for c in df.columns if c not in (*key, version)]
    best = df.groupBy(*key).agg(F.max(F.struct(F.col(version), *[F.col(c) for c in rest])).alias("r"))
    return best.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in df.columns])


def collapsing(df: DataFrame, key: list[str], sign: str, order: str) -> DataFrame:
    """Rows of sign +1 and -1 cancel: a positive sum leaves the last +1 row, a negative sum the
    last -1 row, zero none."""
    rest = [c for c in df.columns if c not in key]
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])
    g = df.groupBy(*key).agg(
        F.sum(sign).alias("_s"), F.max(F.when(F.col(sign) > 0, row)).alias("_p"), F.max(F.when(F.col(sign) < 0, row)).alias("_n"))
    g = g.filter("_s <> 0").withColumn("r", F.when(F.col("_s") > 0, F.col("_p")).otherwise(F.col("_n")))
    return g.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in df.columns])


def versioned_collapsing(df: DataFrame, key: list[str], sign: str, version: str) -> DataFrame:
    """Cancel inside each (key, version); what is left has a non-zero sum."""
    return collapsing(df, [*key, version], sign, sign)


def summing(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Sums by key; keys whose sums are all zero go."""
    out = df.groupBy(*key).agg(*[F.sum(v).alias(v) for v in values])
    return out.filter(reduce(lambda a, b: a | b, [F.col(v) != 0 for v in values]))


def aggregating(partials: DataFrame, key: list[str], sums: list[str] = (), mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """Merge partial states: sums and counts add, minima and maxima combine."""
    return partials.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs])


def deduplicate(df: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    if version:
        return replacing(df, key, version)
    return df.dropDuplicates(key)


def last_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
