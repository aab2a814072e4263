"""The exact all-pairs searches against brute force, in several blocks and on odd vectors."""

import math
import random

import pytest

from sparkwell.operators import vector_search


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _vectors(n, dim=6, seed=1):
    r = random.Random(seed)
    out = [(i, [float(r.randint(-2, 2)) for _ in range(dim)], i % 3) for i in range(n)]  # with equal and zero vectors
    return [(i, v, g) for i, v, g in out]


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))


DISTANCE = {
    "euclidean": lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))),
    "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)), "dot": lambda a, b: -_dot(a, b),
    "cosine": lambda a, b: 1 - (_dot(a, b) / (math.sqrt(_dot(a, a)) * math.sqrt(_dot(b, b))) if any(a) and any(b) else 0.0)}


@pytest.mark.parametrize("metric", sorted(DISTANCE))
def test_batch_knn_matches_brute_force_in_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(vector_search, "ROWS", 40)
    monkeypatch.setattr(vector_search, "QUERIES", 7)
    data = _vectors(150)
    df = spark.createDataFrame(data, "id long, v array<float>, g int").repartition(3)
    near = vector_search.batch_knn(df, df.filter("id % 10 = 0"), "id", "v", 4, metric, 2)
    assert "Join" not in _plan(near)  # a row for each pair of vectors is never made
    want = []
    for q, x, _ in data[::10]:
        best = sorted((DISTANCE[metric](y, x), i) for i, y, _ in data if i != q)[:4]
        want += [(q, i, d, n + 1) for n, (d, i) in enumerate(best)]
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in near.collect()) == sorted(want)


def test_batch_knn_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0]), (4, [1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1.0, None]), (8, []), (None, [0.0, 0.0])]
    df = spark.createDataFrame(data, "id long, v array<float>")
    got = vector_search.batch_knn(df, df.filter("id IN (1, 2)"), "id", "v", 6).orderBy("query_id", "rank").collect()
    # as ORDER BY in SQL: NaN above all numbers, rows without a distance last
    assert [(r.query_id, r.id, str(r.distance)) for r in got] == [
        (1, 3, "5.0"), (1, 6, "inf"), (1, 5, "nan"), (1, 2, "None"), (1, 4, "None"), (1, 7, "None"),
        *[(2, i, "None") for i in (1, 3, 4, 5, 6, 7)]]
    few = vector_search.batch_knn(df, df.filter("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [r.id for r in few] == [3, 6]


def test_similar_pairs_matches_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ROWS", 15)
    data = [(i, v, g % 2) for i, v, g in _vectors(120, 4)] + [(7, [1.0, 1.0, 0.0, 0.0], 0), (500, None, 0), (501, [1.0], 0), (None, [1.0] * 4, 1), (502, [1.0] * 4, None)]
    df = spark.createDataFrame(data, "id long, v array<float>, g int")
    pairs = vector_search.similar_pairs(df, "id", "v", "g", 0.5)
    want = []
    for p, (i, x, g) in enumerate(data):
        for j, y, h in data[p + 1:]:
            if None in (i, j, g, h, x, y) or g != h or i == j or len(x) != len(y):
                continue
            n = _dot(x, x) * _dot(y, y)
            c = _dot(x, y) / math.sqrt(n) if n else 0.0
            if c >= 0.5:
                want.append((min(i, j), max(i, j), c))
    assert sorted((r.a, r.b, r.cosine) for r in pairs.collect()) == sorted(want)


def test_similar_pairs_at_the_threshold(spark):
    """1 / sqrt(2 * 2) is 0.5, as in SQL; the product of two rounded unit vectors is less."""
    df = spark.createDataFrame([(1, [1.0, 1.0, 0.0], 0), (2, [1.0, 0.0, 1.0], 0)], "id long, v array<float>, g int")
    assert [(r.a, r.b, r.cosine) for r in vector_search.similar_pairs(df, "id", "v", "g", 0.5).collect()] == [(1, 2, 0.5)]
