"""Sketches as tables: Count-Min, Bloom filter and t-digest, built by plain aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_min(df: DataFrame, col: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """(row, bucket, n): depth * width counters at most."""
    rows = df.groupBy(F.xxhash64(col).alias("h")).agg(F.count("*").alias("n"))
    cells = rows.select("n", F.posexplode(F.array(*[F.pmod(F.xxhash64("h", F.lit(i)), F.lit(width)) for i in range(depth)])).alias("row", "bucket"))
    return cells.groupBy("row", "bucket").agg(F.sum("n").alias("n"))


def count_min_estimate(sketch: DataFrame, values: DataFrame, col: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """(col, estimate): never below the true count; the sketch is of bounded size."""
    places = values.select(col, F.posexplode(F.array(*[F.pmod(F.xxhash64(F.xxhash64(col), F.lit(i)), F.lit(width)) for i in range(depth)])).alias("row", "bucket"))
    return places.join(F.broadcast(sketch), ["row", "bucket"], "left").groupBy(col).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


#: Words of 64 bits in a block of a Bloom filter.
WORDS = 32


def bloom(df: DataFrame, col: str, expected: int, rate: float = 0.01) -> tuple[DataFrame, int, int]:
    """(blocks as rows, number of blocks, of hashes) for ``expected`` values. All bits of a value lie
    in one block of ``WORDS`` words, so that it goes to its block as one row, whatever the number of
    hashes. Blocks fill unevenly, for which a twentieth of the bits is added."""
    bits = max(64, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / max(1, expected) * math.log(2)))
    blocks = math.ceil(bits * 1.05 / (64 * WORDS))
    placed = df.select(_block(F.col(col), blocks).alias("block"), F.xxhash64(col).alias("_h")).repartition("block")
    at = placed.select("block", F.explode(F.array(*_places(F.col("_h"), hashes))).alias("_p"))
    words = at.groupBy("block", F.shiftright("_p", 6).alias("_w")).agg(F.bit_or(_mask(F.col("_p"))).alias("_m"))
    whole = F.array(*[F.coalesce(F.max(F.when(F.col("_w") == i, F.col("_m"))), F.lit(0).cast("long")) for i in range(WORDS)])
    return words.groupBy("block").agg(whole.alias("words")), blocks, hashes


def _block(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(blocks))


def _places(h: Column, hashes: int) -> list[Column]:
    """Bits of a block, of a value's hash."""
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(64 * WORDS)).cast("int") for i in range(hashes)]


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("mod", place, F.lit(64)))


def bloom_maybe(filter_: tuple[DataFrame, int, int], df: DataFrame, col: str) -> DataFrame:
    """(col, maybe): false only for values that are not in the set."""
    rows, blocks, hashes = filter_
    asked = df.select(col, _block(F.col(col), blocks).alias("block")).repartition("block").groupBy("block", col).agg(F.first(F.xxhash64(col)).alias("_h"))
    hit = F.lit(True)
    for p in _places(F.col("_h"), hashes):
        hit = hit & (F.get("words", F.shiftright(p, 6)).bitwiseAND(_mask(p)) != 0)
    return asked.join(rows, "block", "left").select(col, F.coalesce(hit, F.lit(False)).alias("maybe"))


def t_digest(df: DataFrame, keys: list[str], col: str, compression: int = 100) -> DataFrame:
    """(keys, mean, weight) centroids: equal values are counted first, their ranks scaled by
    asin(2q - 1), so that centroids are small at both ends. At most about ``compression`` a key.
    Ranks of a key are a running sum over its distinct values, rounded to ``compression`` ** 2
    steps of their range before, so that no key has more rows than that."""
    w = W.partitionBy(*keys)
    span = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"))
    step = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * compression**2)).otherwise(0)
    cells = df.filter(F.col(col).isNotNull()).join(F.broadcast(span) if not keys else span, keys or None).groupBy(*keys, "_n", step.alias("_s")).agg(F.sum(col).alias("_sum"), F.count("*").alias("_w"))
    done = F.sum("_w").over(w.orderBy("_s").rowsBetween(W.unboundedPreceding, 0)) - F.col("_w") / 2
    place = F.floor(compression * (F.asin(2 * done / F.col("_n") - 1) / math.pi + 0.5))
    return cells.withColumn("_c", place).groupBy(*keys, "_c").agg((F.sum("_sum") / F.sum("_w")).alias("mean"), F.sum("_w").alias("weight")).drop("_c")


def t_digest_quantile(digest: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys, value): the mean of the centroid in which the quantile falls."""
    w = W.partitionBy(*keys)
    upto = F.sum("weight").over(w.orderBy("mean").rowsBetween(W.unboundedPreceding, 0))
    rows = digest.withColumns({"_up": upto, "_all": F.sum("weight").over(w)})
    return rows.filter(F.col("_up") >= q * F.col("_all")).groupBy(*keys).agg(F.min("mean").alias("value"))
