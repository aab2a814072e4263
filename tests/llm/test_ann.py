import math

import numpy as np

from sparkwell.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vecs, q, k=10):
    x = np.array(vecs[q], np.float32).astype(float)
    out = []
    for i, v in vecs.items():
        if i != q and len(v) == len(x):
            out.append((float(np.sqrt(((np.array(v, np.float32).astype(float) - x) ** 2).sum())), i))
    return sorted(out)[:k]


def table(spark, vecs):
    return spark.createDataFrame([(i, [float(y) for y in v], 0) for i, v in vecs.items()], SCHEMA)


def found(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_small_tables_are_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    vecs = {i: rng.normal(size=8) for i in range(60)} | {i: [1.0] * 8 for i in range(100, 140)}
    df = table(spark, vecs)
    got = found(ann.search(df, df.filter("vec_id % 10 = 0")))
    for q in (0, 10, 100, 130):
        want = brute(vecs, q)
        assert [v for _, v, _ in got[q]] == [i for _, i in want]
        assert np.allclose([s for *_, s in got[q]], [d for d, _ in want])


def test_recall_and_fallback(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vecs = dict(enumerate(x))
    df = table(spark, vecs)
    got = found(ann.search(df, df.filter("vec_id % 100 = 0")))
    hit = sum(len({i for _, i in brute(vecs, q)} & {v for _, v, _ in got[q]}) for q in range(0, 3000, 100))
    assert all(len(got[q]) == 10 for q in range(0, 3000, 100)) and hit / 300 >= 0.9
    monkeypatch.setattr(ann, "TABLES", 1)
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "CELL", 1)
    few = found(ann.search(df, df.filter("vec_id % 100 = 0")))
    assert all(len(few[q]) == 10 for q in range(0, 3000, 100))


def test_recall_at_all_small_sizes(spark):
    rng = np.random.default_rng(9)
    for n in (20, 300, 1_000, 2_000):
        vecs = dict(enumerate(rng.normal(size=(n, 24))))
        df = table(spark, vecs)
        got = found(ann.search(df, df.filter("vec_id % 10 = 0")))
        asked = range(0, n, 10)
        hit = sum(len({i for _, i in brute(vecs, q)} & {v for _, v, _ in got[q]}) for q in asked)
        assert hit >= 0.95 * 10 * len(asked)


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [math.nan, 1.0], 0), (4, [math.inf, 1.0], 0), (5, [None, 1.0], 0), (6, [1.0, 0.1], 0), (6, [1.0, 0.1], 0), (7, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (8, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(ann.search(df, df))
    assert [v for _, v, _ in got[0]] == [6] and [v for _, v, _ in got[6]] == [0] and set(got) == {0, 6}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_cells_do_not_empty_as_tables_grow():
    rng = np.random.default_rng(5)
    for n in (2_001, 10_256, 51_282, 200_000, 512_820, 3_100_000, 10**9):
        assert n / math.prod(2 * a for a in ann.widths(n, 64)) >= ann.CELL
    x = rng.standard_normal((51_282, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:100]
    near = np.argsort(-(q @ x.T), axis=1)[:, 1:11]
    parts, hit = ann.widths(len(x), 64), np.zeros(near.shape, bool)
    for t in range(ann.TABLES):
        probed, held = ann.probe_cells(q, parts, t, ann.probes_for(len(x))), ann.cells(x[near.ravel()], parts, t).reshape(near.shape)
        hit |= (held[:, :, None] == probed[:, None, :]).any(2)
    assert hit.mean() >= 0.92


def test_cells_and_vectors_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, ann.common.materialize

    def keep(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(ann.common, "materialize", keep)
    df = table(spark, dict(enumerate(np.random.default_rng(6).normal(size=(400, 8)))))
    assert ann.search(df, df.filter("vec_id % 100 = 0")).count() == 40
    joins = [line for line in plans["ann-found"].splitlines() if "HashJoin [" in line]
    assert len(joins) == 1 and "BroadcastHashJoin [query_id" in joins[0]  # the queries' vectors, bounded
