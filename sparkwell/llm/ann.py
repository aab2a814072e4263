"""Nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A table's hash of a unit vector is the nearest signed axis after three rounds of random signs
and a fast Hadamard transform; further, narrower hashes are added to it as the number of
vectors grows, so that a cell holds CELL to 2 * CELL of them at any size. A query looks into the
PROBES cells of each table whose axes come closest to its own. Candidates are the distinct
(query, vector) pairs over all tables; all of them are reranked by the exact distance of the
original vectors in double precision.

Equal vectors are one entry of the index (a very common vector is no hot cell): of each such
group the ids that can be among the k nearest, the k + 1 least, are kept, which loses nothing.
Queries that meet fewer than k entries are compared with all vectors, in blocks. Where a table
has no more than PROBES cells (some 250 vectors) every cell is looked into, and the search is exact.

The vectors of the queries are broadcast while they take at most BROADCAST_BYTES, else they
join by shuffle. Nothing else that follows the number of vectors is broadcast: cells and vectors
meet by shuffle, whatever size Spark takes them to have.

Cases: vectors null, zero, or with null or non-finite components take no part, nor do rows
with a null id; rows that repeat an id and vector count once; vectors of different lengths are
never compared; ties go to the smaller id; extra columns are ignored; an empty table gives an
empty result; a query without any other vector gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

K = 10
TABLES = 32
PROBES = 22
CELL = 6
QUERY_EVERY = 100
BROADCAST_BYTES = 32 << 20
BLOCKS = 64
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    x = x.copy()
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def widths(n: int, dim: int) -> list[int]:
    """How many axes each hash of a table chooses among, for n vectors: as many as leave CELL
    of them or more a cell, as PROBES finds too few neighbours in smaller ones."""
    d = 1 << max(1, (dim - 1).bit_length())
    out: list[int] = []
    cells = 1
    while not out or 2 * cells * CELL <= n:  # a hash of one axis halves the cells
        axes = min(d, 1 << int(math.log2(max(1.0, n / (CELL * cells) / 2))))
        out.append(axes)
        cells *= 2 * axes
    return out


def probes_for(n: int) -> int:
    """More cells are looked into as they get smaller in angle."""
    return max(PROBES, round(PROBES * (n / 50_000) ** 0.3))


def _rotations(x: np.ndarray, parts: list[int], table: int) -> list[np.ndarray]:
    """For every hash of the table the products with its axes, as +a0, -a0, +a1, ..."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    out = []
    for k, axes in enumerate(parts):
        rng = np.random.default_rng([SEED, table, k, dim])
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], d))
        y = y[:, :axes]
        out.append(np.stack([y, -y], axis=2).reshape(n, 2 * axes))
    return out


def cells(x: np.ndarray, parts: list[int], table: int) -> np.ndarray:
    key = np.zeros(len(x), np.int64)
    for y in _rotations(x, parts, table):
        key = key * y.shape[1] + y.argmax(1)
    return key


def probe_cells(x: np.ndarray, parts: list[int], table: int, count: int) -> np.ndarray:
    """The ``count`` cells whose axes fall short of the best by the least sum of squares."""
    key, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for y in _rotations(x, parts, table):
        short = (y.max(1, keepdims=True) - y) ** 2
        cost = (cost[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        key = (key[:, :, None] * y.shape[1] + np.arange(y.shape[1])[None, None, :]).reshape(len(x), -1)
        if cost.shape[1] > count:  # a best sum has best parts, so nothing better is lost
            best = np.argpartition(cost, count - 1, axis=1)[:, :count]
            cost, key = np.take_along_axis(cost, best, 1), np.take_along_axis(key, best, 1)
    return key


def _hashed(rows: DataFrame, id_col: str, parts_of: dict[int, list[int]], probing: int | None) -> DataFrame:
    """(cell, id): a row for each table, or for each table and probed cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, lists = b.column(0).to_numpy(), b.column(1)
            length = lists.value_lengths().to_numpy()
            flat, offset = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(length)])
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                x = flat[(offset[at][:, None] + np.arange(dim)[None, :])]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                parts = parts_of[int(dim)]
                for t in range(TABLES):
                    key = cells(x, parts, t)[:, None] if probing is None else probe_cells(x, parts, t, probing)
                    # dimension, table and cell in one number
                    full = key + (np.int64(t) << np.int64(50)) + (np.int64(dim % 127) << np.int64(56))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full.ravel()), pa.array(np.repeat(ids[at], key.shape[1]))], ["cell", id_col])

    return rows.mapInArrow(run, f"cell long, {id_col} long")


def _distances(pairs: DataFrame) -> DataFrame:
    """(query_id, rep, score) of rows with both vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, v = b.column(2), b.column(3)
            n = v.value_lengths().to_numpy()
            same = (q.value_lengths().to_numpy() == n)
            if not same.all():
                b = b.filter(pa.array(same))
                q, v, n = b.column(2), b.column(3), n[same]
                if not b.num_rows:
                    continue
            d = (q.flatten().to_numpy(zero_copy_only=False).astype(float) - v.flatten().to_numpy(zero_copy_only=False).astype(float)) ** 2
            score = np.sqrt(np.add.reduceat(d, np.concatenate([[0], np.cumsum(n)[:-1]])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query_id", "rep", "score"])

    return pairs.select("query_id", "rep", "q", "v").mapInArrow(run, "query_id long, rep long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; both frames have vec_id and
    embedding, a query's own id is no candidate."""

    def usable(df: DataFrame) -> DataFrame:
        ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        some = F.exists("embedding", lambda x: x != 0)
        df = df.select(F.col("vec_id").cast("long"), "embedding")
        return df.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ok & some)

    order = W.partitionBy("embedding").orderBy("vec_id")
    kept = usable(vectors).distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    # An entry is known by its vector's hash, as an id may come with several vectors.
    kept = common.materialize(kept.withColumn("rep", F.xxhash64("embedding")), "ann-vectors")
    entries = kept.filter("place = 1").select("rep", F.col("embedding").alias("v"))
    members = kept.select("rep", "vec_id")
    wanted = common.materialize(
        usable(queries).distinct().select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "ann-queries")
    sizes = {r["d"]: r["count"] for r in entries.groupBy(F.size("v").alias("d")).count().collect()}
    parts_of = {d: widths(n, d) for d, n in sizes.items()}
    n_queries, width = wanted.count(), max(sizes, default=1)
    wanted_here = wanted.filter(F.size("q").isin(list(sizes))) if sizes else wanted.limit(0)
    index = _hashed(entries.select("rep", "v"), "rep", parts_of, None)
    asked = _hashed(wanted_here.select("query_id", "q"), "query_id", parts_of, probes_for(max(sizes.values(), default=0)))
    # Spark takes a query's hundreds of cells for one row and would broadcast them all; they grow with
    # the table, so these joins are told to shuffle.
    pairs = asked.join(index.hint("merge"), "cell").select("query_id", "rep").distinct()
    small = F.broadcast(wanted_here) if n_queries * width * 8 <= BROADCAST_BYTES else wanted_here.hint("merge")
    scored = _distances(pairs.join(entries.hint("merge"), "rep").join(small, "query_id"))
    best = W.partitionBy("query_id").orderBy("score")  # with rank(), ties at the cut stay
    top = scored.withColumn("_r", F.rank().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    near = common.materialize(_expand(top, members, k), "ann-found")
    lacking = near.groupBy("query_id").count()
    lacking = wanted.join(lacking, "query_id", "left").filter(F.coalesce("count", F.lit(0)) < k).select("query_id", "q")
    if lacking.head(1):
        blocks = entries.withColumn("block", F.pmod(F.hash("rep"), F.lit(BLOCKS)))
        every = lacking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
        full = _distances(every.join(blocks.hint("merge"), "block"))
        top = full.withColumn("_r", F.rank().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
        near = near.join(lacking.select("query_id"), "query_id", "left_anti").unionByName(_expand(top, members, k))
    rank = W.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _expand(top: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k nearest ids behind the entries of ``top``."""
    rank = W.partitionBy("query_id").orderBy("score", "vec_id")
    rows = top.join(members.hint("merge"), "rep").filter(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return rows.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= k).drop("_r")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))
