"""Statistics of large counts and exact percentiles."""

import random

import duckdb
import pytest

from sparkwell.operators import stats
from sparkwell.plans import catalog


def test_chi_square_of_counts_whose_products_leave_a_long(spark):
    rows = spark.range(4_000_000).selectExpr("id % 2 AS a", "IF(id < 1000, 0, id % 2) AS b")
    got = stats.chi_square_independence(rows, "a", "b").head()
    cells, total = {(0, 0): 2_000_000, (1, 0): 500, (1, 1): 1_999_500, (0, 1): 0}, 4_000_000
    row, col = {0: 2_000_000, 1: 2_000_000}, {0: 2_000_500, 1: 1_999_500}
    want = sum((n - row[x] * col[y] / total) ** 2 / (row[x] * col[y] / total) for (x, y), n in cells.items())
    assert got["chi2"] == pytest.approx(want, rel=1e-12) and got["df"] == 1


def test_percentiles_by_ranges_are_those_of_sql(spark):
    """Nulls, a null key, a group without values, a very common value; the values of a group lie in several tasks."""
    r = random.Random(3)
    data = [(r.choice("ab"), r.choice([None, 1.0, 1.0, r.randint(0, 300) / 4])) for _ in range(900)]
    data += [(None, 2.0), (None, 5.0), ("c", None), ("d", 7.5)]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {"m": ("cont", 0.5), "hi": ("cont", 0.95), "lo": ("disc", 0.25), "first": ("disc", 0.0), "last": ("cont", 1.0)}
    made = stats.percentiles(df, ["k"], "v", wanted)
    got = {x.k: (x.m, round(x.hi, 9) if x.hi else x.hi, x.lo, x.first, x.last) for x in made.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", data)
    want = con.execute("SELECT k, median(v), round(quantile_cont(v, 0.95), 9), quantile_disc(v, 0.25), quantile_disc(v, 0.0), max(v) FROM t GROUP BY k").fetchall()
    assert got == {x[0]: x[1:] for x in want}


@pytest.mark.parametrize("name", ["d_percentiles", "d_t_digest", "d_approx_bounds"])
def test_no_task_holds_all_values_of_a_group(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "percentile_cont(" not in plan and "percentiledisc(" not in plan.lower() and "median(" not in plan and "Expand" not in plan
