"""Exact k-NN, filtered and hybrid search, IVF lists and quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from . import pairwise

#: Rows and queries of a block of the exact all-pairs searches.
ROWS, QUERIES = 16_384, 8_192


def knn(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, metric: str = "euclidean", where: Column | None = None) -> DataFrame:
    """The k nearest rows of one query vector; each task keeps its own k."""
    rows = df if where is None else df.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, vectors.distance(F.col(vec_col), q, metric).alias("distance")).orderBy("distance", id_col).limit(k)


def batch_knn(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "euclidean", blocks: int = 16) -> DataFrame:
    """(query_id, id, distance, rank) of a stated set of queries against all rows, exact: rows and
    queries lie in blocks of bounded size, each pair of blocks is one group of one task, which gives
    k rows a query (``pairwise.nearest``). Rows without a distance come last, as in SQL."""
    b, parts = max(blocks, -(-df.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    place = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = [F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")]
    known = F.col(id_col).isNotNull()
    d = df.filter(known).select(place(b).alias("_b"), each(parts).alias("_p"), F.lit(False).alias("_asks"), *row)
    q = queries.filter(known).select(each(b).alias("_b"), place(parts).alias("_p"), F.lit(True).alias("_asks"), *row)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids, vecs = (t.column(c).combine_chunks() for c in ("_asks", "_id", "_v"))
        asks, codes = asks.to_numpy(zero_copy_only=False), pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        at_q, at_d, kind = np.flatnonzero(asks), np.flatnonzero(~asks), np.full(len(asks), -1)
        found = []
        for rows, m in pairwise.classes(vecs):
            kind[rows] = m.shape[1]
            i, j = asks[rows], ~asks[rows]
            if i.any() and j.any():
                x, y, dist = pairwise.nearest(m[i], codes[rows[i]], m[j], codes[rows[j]], k, metric)
                found.append((rows[i][x], rows[j][y], dist))
        got = np.bincount(np.concatenate([f[0] for f in found]), minlength=len(asks)) if found else np.zeros(len(asks), int)
        if len(at_d) and (kind[at_d[0]] < 0 or (kind != kind[at_d[0]]).any()):  # rows without a distance fill up
            sorted_d = at_d[np.argsort(codes[at_d], kind="stable")]
            for i in at_q[got[at_q] < k]:
                rest = sorted_d[((kind[sorted_d] != kind[i]) | (kind[i] < 0)) & (codes[sorted_d] != codes[i])][:k]
                found.append((np.full(len(rest), i), rest, np.full(len(rest), np.nan)))
        x, y, dist = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        none = (kind[x] != kind[y]) | (kind[x] < 0)
        return pa.table({"query_id": ids.take(pa.array(x)), id_col: ids.take(pa.array(y)), "distance": pa.array(dist, mask=none)})

    out = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField(id_col, df.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])
    near = d.unionByName(q).groupBy("_b", "_p").applyInArrow(run, out)
    w = W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), id_col)
    return near.select("query_id", id_col, "distance").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, id_col: str, weights: tuple[float, float] = (0.5, 0.5), constant: int = 60) -> DataFrame:
    """(id, score) of two ranked lists (id, rank from 0): w / (constant + rank + 1), summed."""
    x = a.select(id_col, (weights[0] / (constant + F.col("rank") + 1)).alias("_a"))
    y = b.select(id_col, (weights[1] / (constant + F.col("rank") + 1)).alias("_b"))
    return x.join(y, id_col, "full").select(id_col, (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("score"))


def linear_fusion(a: DataFrame, b: DataFrame, id_col: str, alpha: float = 0.5) -> DataFrame:
    """alpha * similarity + (1-alpha) * text score, both brought to 0..1; ``a`` has distance."""
    def scaled(df: DataFrame, col: str, name: str, invert: bool) -> DataFrame:
        s = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        v = F.coalesce(F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(1.0 if not invert else 0.0))
        return df.join(s).select(id_col, ((1 - v) if invert else v).alias(name))

    x, y = scaled(a, "distance", "_a", True), scaled(b, "score", "_b", False)
    return x.join(y, id_col, "full").select(id_col, (alpha * F.coalesce("_a", F.lit(0.0)) + (1 - alpha) * F.coalesce("_b", F.lit(0.0))).alias("score"))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, group: str, threshold: float) -> DataFrame:
    """(a, b, cosine) over a threshold among the rows of one group, exact: a group's rows lie in
    blocks of bounded size, each pair of its blocks is one group of one task (``pairwise.similar``)."""
    rows = df.select(F.col(group).alias("_g"), F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")).filter("_g IS NOT NULL AND _id IS NOT NULL")
    sizes = rows.groupBy("_g").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_n"))
    mine = F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    laid = rows.join(sizes, "_g").select("_g", mine.alias("_m"), other.alias("_o"), "_id", "_v")
    laid = laid.select("_g", F.least("_m", "_o").alias("_p"), F.greatest("_m", "_o").alias("_q"), (F.col("_m") > F.col("_o")).alias("_right"), "_id", "_v")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, right = t.column("_id").combine_chunks(), t.column("_right").to_numpy()
        alone = key[1].as_py() == key[2].as_py()
        for at, m in pairwise.classes(t.column("_v").combine_chunks()):
            r = right[at]
            left, l_ids, r_ids = (m, at, at) if alone else (m[~r], at[~r], at[r])
            for x, y, c in pairwise.similar(left, None if alone else m[r], threshold):
                if len(x):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(l_ids[x])), ids.take(pa.array(r_ids[y])), pa.array(c)], ["x", "y", "cosine"])

    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("cosine", T.DoubleType())])
    found = laid.groupBy("_g", "_p", "_q").applyInArrow(run, out)
    return found.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def ivf(df: DataFrame, id_col: str, vec_col: str, lists: int, seed: int = 1):
    """A k-means model and the rows with their list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(id_col, vec_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(rows)
    return model, model.transform(rows).select(id_col, vec_col, F.col("prediction").alias("list"))


def ivf_search(model, indexed: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, probes: int) -> DataFrame:
    """k nearest among the lists whose centres are nearest."""
    order = sorted(range(len(model.clusterCenters())), key=lambda i: sum((a - b) ** 2 for a, b in zip(model.clusterCenters()[i], query)))
    return knn(indexed.filter(F.col("list").isin(order[:probes])), id_col, vec_col, query, k)


def scalar_quantize(v: Column, lo: float, hi: float) -> Column:
    """Codes 0..255 of a fixed range."""
    return F.transform(v, lambda x: F.round((F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) * 255).cast("int"))


def binary_quantize(v: Column) -> Column:
    return F.transform(v, lambda x: (x > 0).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def rerank(candidates: DataFrame, vectors_df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int) -> DataFrame:
    return knn(candidates.select(id_col).join(vectors_df, id_col), id_col, vec_col, query, k)
