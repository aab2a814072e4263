"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], direction: str = "backward",
              tolerance: float | None = None, prefix: str = "r_") -> DataFrame:
    """Every left row with the right row nearest in ``on`` among those of its ``by``, or nulls.

    ``backward`` takes the last at or before, ``forward`` the first at or after, ``nearest``
    the closer of both (the earlier on a tie). ``tolerance`` (inclusive) is in units of ``on``,
    seconds for timestamps. One shuffle: both sides are united and a window carries the last
    right row forward. Columns of ``right`` get ``prefix``. Of right rows equal in ``by`` and
    ``on`` the greatest in all columns counts."""
    names = right.columns
    row = F.struct(F.col(on).alias("_on"), *[F.col(c).alias(c) for c in names])
    packed = right.filter(F.col(on).isNotNull()).select(*by, F.col(on).alias("_t"), row.alias("_r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"))
    asked = left.select(*by, F.col(on).alias("_t"), F.lit(None).cast(packed.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    both = asked.unionByName(packed)
    is_left = F.col("_l").isNotNull()

    def carry(forward: bool):
        # Backward: right rows stand before left rows of the same time; forward: in reverse order.
        t = F.col("_t").desc() if forward else F.col("_t").asc()
        last = F.col("_r").desc_nulls_last() if forward else F.col("_r").asc_nulls_last()
        w = W.partitionBy(*by).orderBy(t, is_left.asc(), last).rowsBetween(W.unboundedPreceding, W.currentRow)
        return F.last("_r", ignorenulls=True).over(w)

    if direction in ("backward", "forward"):
        both = both.withColumn("_m", carry(direction == "forward"))
    else:
        both = both.withColumns({"_b": carry(False), "_f": carry(True)})
        near = (_num("_f._on", both) - _num("_t", both)) < (_num("_t", both) - _num("_b._on", both))
        both = both.withColumn("_m", F.when(F.col("_b").isNull(), F.col("_f")).when(F.col("_f").isNull(), F.col("_b")).when(near, F.col("_f")).otherwise(F.col("_b")))
    out = both.filter(is_left)
    ok = F.lit(True) if tolerance is None else F.abs(_num("_m._on", out) - _num("_t", out)) <= tolerance
    ok = ok & F.col("_t").isNotNull()
    return out.select("_l.*", *[F.when(ok, F.col(f"_m.{c}")).alias(prefix + c) for c in names])


def _num(c: str, df: DataFrame):
    kind = df.select(c).schema[0].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return F.col(c).cast("double")


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows with lo <= at < hi. Both sides are cut into cells of ``width`` and meet by equality
    of the cell, so nothing is compared with everything; a range is repeated for each cell it
    covers, and ``width`` should be near a typical range."""
    cell = F.floor(F.col(at) / width)
    cells = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    left = points.withColumn("_cell", cell)
    right = ranges.filter(F.col(lo) < F.col(hi)).withColumn("_cell", F.explode(cells))
    return left.join(right, "_cell").filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def salted_join(big: DataFrame, other: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join for keys that hold very many rows of ``big``: its rows are dealt over
    ``salts`` values at random by content and ``other`` is repeated for each."""
    a = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    b = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def dictionary_lookup(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, default, limit: int = 1_000_000) -> DataFrame:
    """Left join to a dictionary with a default; it is broadcast if it has at most ``limit`` rows."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(value)).dropDuplicates(["_k"])
    if d.limit(limit + 1).count() <= limit:
        d = F.broadcast(d)
    return facts.join(d, F.col(key) == F.col("_k"), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default))).drop("_k")
