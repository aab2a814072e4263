"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have;
the whole part is given at once, the fraction is rounded by a pivotal process that keeps the
source's words: two documents with fractions p and q of sizes s and t trade mass so that
s*p + t*q stays, in a random direction with the chances that keep each expectation, until one
fraction is 0 or 1. Trades are made inside size classes (powers of two), the largest first. The
one document a class leaves open trades with all smaller documents of the group as one partner,
each of which gives or takes by the room it has, so that it is settled at once where they have the
words for it. What remains open is so one document of the smallest class; these go up a reduction
tree, FAN groups at a time, until one a source is left, which is rounded by its chance. A source
misses its target by less than one small document, or by what its smaller documents can't take up.

Groups are (source, hash of the row), at most about GROUP rows each, so a
source with a third of all rows is spread over as many groups as it needs. Equal rows are counted
first and numbered, so that they spread, too. Random numbers come from the group and its rows in
order of size and id, so reruns agree however rows lie.

Cases: null or empty texts have size 0: they cost no words, and are rounded by their chance alone;
a null source is a source of its own, last in order; null ids and repeated rows are documents of
their own; extra columns, of any name, pass through ``stage`` and are ignored by ``plan``; an empty
table, or one without words, takes nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
CAP = 3.0
SHARE = 1.0
GROUP = 8_000
FAN = 64
SEED = 20_240_517


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = SHARE) -> DataFrame:
    """(source, source_size, target, copies, n) for the (source, size) rows of a corpus.

    Target = min(cap * size, level * weight), where the level makes the targets sum to
    ``share`` of all sizes: what resharing every excess by weight converges to. Works on one
    row a source; the windows run over that table only."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    turn = W.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(table, ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("top", cap * F.col("source_size")).withColumn("full_at", F.col("top") / F.col("w"))
    # Sources fill up in order of full_at; the level is fixed at the first that needn't.
    by = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = (
        per.withColumn("goal", share * F.sum("source_size").over(everything))
        .withColumn("used", F.coalesce(F.sum("top").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.greatest(F.col("goal") - F.col("used"), F.lit(0.0)) / F.col("left_w"))
    )
    # Level if all sources before this one are full; the first where it is not above full_at holds.
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return per.withColumn("target", F.least("top", F.coalesce(level, F.lit(float("inf"))) * F.col("w"))).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies"), "n",
    )


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round fractions of one size class so that sum(p*size) stays; returns them and the index of the one
    fractional entry left (-1 if none). Rows without words are rounded alone."""
    p = p.copy()
    draws = rng.random(len(p))
    keep = -1
    eps = 1e-9
    for i in range(len(p)):
        if size[i] == 0:
            p[i] = 1.0 if draws[i] < p[i] else 0.0
            continue
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        if keep < 0:
            keep = i
            continue
        s, t = size[keep], size[i]
        # Either mass goes from i to keep (up) or from keep to i (down), in words.
        up = min((1 - p[keep]) * s, p[i] * t)
        down = min(p[keep] * s, (1 - p[i]) * t)
        move = up if draws[i] * (up + down) < down else -down
        a, b = p[keep] + move / s, p[i] - move / t
        p[keep], p[i] = a, b
        a_done, b_done = min(a, 1 - a) <= eps, min(b, 1 - b) <= eps
        if a_done:
            p[keep] = round(a)
        if b_done:
            p[i] = round(b)
        keep = -1 if a_done and b_done else (i if a_done else keep)
    return p, keep


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractions class by class, the largest first; returns them and the index of the
    one fractional entry left (-1 if none), of the smallest class where there is room."""
    p, size = p.astype(float), size.astype(float)
    level = np.floor(np.log2(np.maximum(size, 1)))
    level[size == 0] = -1
    keep = -1
    for c in np.unique(level)[::-1]:
        at = np.flatnonzero(level == c)
        if keep >= 0:  # of a larger class
            rest = np.flatnonzero((level <= c) & (size > 0))
            give = np.minimum(p[rest], 1 - p[rest])
            room = (give * size[rest]).sum()
            if room > 0:  # it trades with all that are smaller at once, as one partner
                up, down = min((1 - p[keep]) * size[keep], room), min(p[keep] * size[keep], room)
                words = up if rng.random() * (up + down) < down else -down
                p[keep] += words / size[keep]
                p[rest] -= words / room * give
            if min(p[keep], 1 - p[keep]) <= 1e-9:
                p[keep], keep = round(p[keep]), -1
            elif c >= 0:
                at = np.append(keep, at)
        p[at], last = pivot(p[at], size[at], rng)
        if c >= 0:
            keep = int(at[last]) if last >= 0 else -1
    return p, keep


def _reduce(level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "h", "k"], ascending=[False, True, True, True], na_position="last", ignore_index=True)
        name = "\x00" if key[0] is None or key[0] != key[0] else f"s{key[0]}"
        rng = np.random.default_rng([SEED, level, zlib.crc32(name.encode()), int(key[1])])
        p, keep = settle(rows["p"].to_numpy(float), rows["size"].to_numpy(float), rng)
        if last and keep >= 0:
            p[keep] = 1.0 if rng.random() < p[keep] else 0.0
            keep = -1
        rows["p"] = p
        rows["open"] = np.arange(len(rows)) == keep
        rows["g"] = rows["g"] // FAN
        return rows

    return run


#: Numbers of equal rows are made in blocks of this many.
BLOCK = 10_000


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows (doc_id, source, size, h) as rows numbered by k."""
    alike = common.materialize(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")), "mix-rows")
    last = F.floor((F.col("m") - 1) / BLOCK)
    blocks = alike.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("b") * BLOCK
    return blocks.withColumn("k", F.explode(F.sequence(first, F.least(first + BLOCK, "m") - 1))).drop("m", "b")


def plan_rows(rows: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = SHARE,
              group: int = GROUP) -> DataFrame:
    """The plan of rows (doc_id, source, size, h); h tells rows of an id and size apart."""
    sized = _numbered(rows)
    goal = common.materialize(targets(sized, weights, cap, share), "mix-targets")
    groups = max(1, math.ceil((goal.agg(F.max("n")).head()[0] or 0) / group))
    rows = sized.join(goal, sized.source.eqNullSafe(goal.source)).drop(goal.source)
    rows = rows.select(
        "doc_id", "source", "size", "h", "k", "source_size", "target",
        F.floor("copies").cast("long").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"),
        F.pmod(F.xxhash64("doc_id", "h", "k", F.lit(SEED)), F.ceil(F.col("n") / group)).cast("long").alias("g"),
    )
    schema = "doc_id long, source string, size long, h long, k long, source_size long, target double, whole long, p double, g long, open boolean"
    level, decided = 0, []
    while True:
        last = groups == 1
        rows = common.materialize(rows.groupBy("source", "g").applyInPandas(_reduce(level, last), schema), f"mix-level{level}")
        decided.append(rows.filter(~F.col("open")))
        if last:
            break
        rows = rows.filter("open").drop("open")
        groups, level = math.ceil(groups / FAN), level + 1
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"), "h"
    )


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = SHARE,
         group: int = GROUP) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies (long), and h, the
    hash of its text."""
    rows = docs.select(F.col("doc_id").cast("long"), "source", common.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    return plan_rows(rows, weights, cap, share, group)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns: rows that share it are alike and stand for each other."""
    odd = ("map<", "variant")
    return F.xxhash64(*[
        F.to_json(F.struct(F.col(f"`{c}`"))) if any(o in t for o in odd) else F.col(f"`{c}`") for c, t in docs.dtypes])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document appears as often as the mix takes it. Rows alike in all
    columns are one row with the sum of their copies."""
    names = docs.columns
    key, total, many, block = common.fresh(names, "_h", "_copies", "_many", "_block")
    rows = docs.select(F.col("doc_id").cast("long"), "source", common.word_count(F.col("text")).alias("size"), _row_hash(docs).alias("h"))
    chosen = plan_rows(rows).groupBy("h").agg(F.sum("copies").alias("copies"), F.count("*").alias("m")).filter("copies > 0")
    chosen = chosen.select(F.col("h").alias(key), F.col("copies").alias(total), (F.col("m") > 1).alias(many))
    hit = docs.withColumn(key, _row_hash(docs)).join(chosen, key)
    hit = hit.filter(~F.col(many)).unionByName(hit.filter(many).dropDuplicates([key]))
    # As many rows as copies, in blocks.
    times = F.least(F.lit(BLOCK).cast("long"), F.col(total) - F.col(block) * BLOCK)
    hit = hit.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(total) - 1) / BLOCK))))
    hit = hit.withColumn(block, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return hit.select(*[f"`{c}`" for c in names])
