import os
import random
from collections import defaultdict

import pytest

from sparkwell.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size int"


def docs(spark, n=600, seed=1):
    rng = random.Random(seed)
    src = lambda i: ["a", "b", "c", "d", None][min(int(rng.random() * 5) if i % 3 else 0, 4)]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), src(i), "en", 1, 7) for i in range(n)]
    rows += [(None, "x y", "a", "en", 1, 7), (None, "x y", "a", "en", 1, 7), (5, None, "b", None, None, None), (5, "", "b", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def waterfill(sizes, weights, cap):
    """Targets by resharing the excess until none is left."""
    total, t, full = sum(sizes), [0.0] * len(sizes), set()
    left = float(total)
    while left > 1e-9 and len(full) < len(sizes):
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        share = left
        left = 0.0
        for i in range(len(sizes)):
            if i in full:
                continue
            t[i] += share * weights[i] / w
            if t[i] >= cap * sizes[i]:
                left += t[i] - cap * sizes[i]
                t[i] = cap * sizes[i]
                full.add(i)
    return t


def test_targets_and_totals(spark):
    out = mixing.plan(docs(spark), group=40).collect()
    assert len(out) == 604
    size, got, target, biggest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r.source] += r.size
        got[r.source] += r.size * r.copies
        target[r.source], biggest[r.source] = r.target, max(biggest[r.source], r.size)
        assert 0 <= r.copies <= 3 and r.source_size >= r.size
    names = ["a", "b", "c", "d", None]
    want = waterfill([size[s] for s in names], [1, 2, 3, 1, 2], 3.0)
    assert [target[s] for s in names] == pytest.approx(want)
    for s in names:  # 40 rows a group, of up to 60 words
        assert abs(got[s] - target[s]) <= 20


def test_cap_is_reshared(spark):
    rows = [(i, "w " * n, s, "en", 1, 7) for i, (s, n) in enumerate([("a", 1000), ("b", 10), ("c", 20)])]
    per = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, SCHEMA).select("source", mixing.common.word_count(mixing.F.col("text")).alias("size"))).collect()}
    assert per == pytest.approx({"a": 940.0, "b": 30.0, "c": 60.0})


def test_reruns_agree_on_any_layout(spark):
    d = docs(spark)
    a = sorted(mixing.plan(d.repartition(7), group=40).collect(), key=str)
    assert a == sorted(mixing.plan(d.repartition(2), group=40).collect(), key=str)


def test_a_huge_document_is_made_up_for_by_small_ones(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(20, 200), "ab"[i % 2], "en", 1, 7) for i in range(3600)]
    rows += [(5000 + i, "w " * 20_000, "a", "en", 1, 7) for i in range(3)] + [(6000, "w " * 9_000, "b", "en", 1, 7)]
    out = mixing.plan(spark.createDataFrame(rows, SCHEMA), weights=(2, 3), group=900).collect()
    for s in "ab":
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 100


def test_expectations_stay():
    import numpy as np

    size = np.array([1000.0] * 3 + [100.0] * 10 + [10.0] * 40 + [0.0] * 5)
    p = np.full(len(size), 0.3)
    runs = []
    for i in range(3000):
        q, keep = mixing.settle(p, size, np.random.default_rng(i))
        assert ((q == 0) | (q == 1) | (np.arange(len(q)) == keep)).all()
        runs.append(q)
    assert np.abs(np.mean(runs, 0) - 0.3).max() < 0.05


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_sources_are_within_a_hundredth_of_their_targets(spark):
    out = mixing.plan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    per = out.groupBy("source").agg(mixing.F.sum(mixing.F.col("copies") * mixing.F.col("size")).alias("got"), mixing.F.max("target").alias("target"))
    assert all(abs(r.got - r.target) <= 0.01 * r.target for r in per.collect())


def test_hot_repeated_rows_spread_and_clashing_names_pass(spark):
    rows = [(None, "x y z", "a")] * 3000 + [(i, "w " * (i % 9), "b") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = "_id _source _size _h _n _copies _c _k _many _block h k m b g p open size copies whole target source_size".split()
    d = d.withColumns({c: mixing.F.lit(5) for c in extra}).withColumn("m", mixing.F.create_map(mixing.F.lit("a"), mixing.F.lit(1)))
    out = mixing.stage(spark, d, "")
    assert out.columns == d.columns
    rows = d.select("doc_id", "source", mixing.common.word_count(mixing.F.col("text")).alias("size"), mixing._row_hash(d).alias("h"))
    assert out.count() == mixing.plan_rows(rows).agg({"copies": "sum"}).head()[0]
    assert out.filter("_copies = 5 and open = 5").count() == out.count()


def test_stage_repeats_rows(spark):
    d = docs(spark)
    plan = mixing.plan(d.select("doc_id", "source", "text"))
    out = mixing.stage(spark, d, "")
    assert out.columns == d.columns
    assert out.count() == plan.agg({"copies": "sum"}).head()[0]


def test_empty(spark):
    d = docs(spark).limit(0)
    assert mixing.plan(d).count() == 0 and mixing.stage(spark, d, "").count() == 0
    z = spark.createDataFrame([(1, None, "a", "en", 0, 0)], SCHEMA)
    assert [r.copies for r in mixing.plan(z).collect()] == [0]
