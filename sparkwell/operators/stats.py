"""Hypothesis tests and sketches, from aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def t_test_one(df: DataFrame, value: str, mu: float) -> DataFrame:
    g = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return g.select(((F.col("mean") - mu) / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).cast("double").alias("df"))


def t_test_two(df: DataFrame, group: str, a, b, value: str) -> DataFrame:
    """Welch's t with Welch-Satterthwaite degrees of freedom."""
    def of(x, name):
        v = F.when(F.col(group) == x, F.col(value))
        return [F.avg(v).alias(f"m{name}"), F.var_samp(v).alias(f"v{name}"), F.count(v).alias(f"n{name}")]

    g = df.agg(*of(a, "a"), *of(b, "b")).withColumns({"sa": F.col("va") / F.col("na"), "sb": F.col("vb") / F.col("nb")})
    return g.select(
        ((F.col("ma") - F.col("mb")) / F.sqrt(F.col("sa") + F.col("sb"))).alias("t"),
        (F.pow(F.col("sa") + F.col("sb"), 2) / (F.pow("sa", F.lit(2)) / (F.col("na") - 1) + F.pow("sb", F.lit(2)) / (F.col("nb") - 1))).alias("df"))


def chi_square_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of the contingency table of two columns."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # In doubles, as products of counts leave a long. Empty cells add their expectation: what the others leave of n.
    e = F.col("r").cast("double") * F.col("c") / F.col("n")
    s = cells.join(rows, a).join(cols, b).join(total).agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("s"), F.sum(e).alias("e"), F.first("n").alias("n"))
    dims = cells.agg(((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))
    return s.join(dims).select((F.col("s") + F.col("n") - F.col("e")).alias("chi2"), "df")


def chi_square_fit(df: DataFrame, value: str, expected: dict) -> DataFrame:
    """Goodness of fit to given shares of categories."""
    want = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in expected.items()], "k string, p double")
    got = df.groupBy(F.col(value).cast("string").alias("k")).agg(F.count("*").alias("o"))
    total = got.agg(F.sum("o").alias("n"))
    return want.join(got, "k", "left").join(total).agg(
        F.sum(F.pow(F.coalesce("o", F.lit(0)) - F.col("p") * F.col("n"), F.lit(2)) / (F.col("p") * F.col("n"))).alias("chi2"), (F.count("*") - 1).alias("df"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F statistic with its degrees of freedom."""
    g = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    return t.select(
        ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"),
        (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def population_stability(expected: DataFrame, actual: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """PSI over fixed bins, and its severity."""
    def share(df: DataFrame, name: str) -> DataFrame:
        b = F.lit(0)
        for e in edges:
            b = b + (F.col(value) >= e).cast("int")
        g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("c"))
        return g.join(g.agg(F.sum("c").alias("n"))).select("bin", (F.col("c") / F.col("n")).alias(name))

    both = share(expected, "e").join(share(actual, "a"), "bin", "full").na.fill(1e-6, ["e", "a"])
    psi = both.agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))
    p = F.col("psi")
    return psi.withColumn("severity", F.when(p < 0.1, "none").when(p < 0.2, "low").when(p < 0.3, "medium").when(p < 0.5, "high").otherwise("critical"))


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, a column of each name in ``wanted``), exact: ``("cont", p)`` interpolates, ``("disc", p)``
    takes a value that is there; null where a group has no value, a null key is a group.

    Equal values are counted, the counts lie in ranges of (keys, value) over the partitions and are
    written once. Sums by range say in which ranges a rank falls; only these are summed value by
    value, so that no task has more than a range."""
    from pyspark.sql import Window as W

    from ..sources import tables

    names = [f"_k{i}" for i in range(len(keys))]
    same = [F.col(k).alias(n) for k, n in zip(keys, names)]
    v = F.col(value)
    counted = df.select(*same, v.alias("_v")).groupBy(*names, "_v").agg(F.count("*").alias("_n"))
    cells = tables.checkpoint(counted.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()))
    present = cells.filter("_v IS NOT NULL")
    by = W.partitionBy(*names)
    ranges = present.groupBy(*names, "_part").agg(F.sum("_n").alias("_in"))
    ranges = ranges.withColumns({"_before": F.sum("_in").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_in"), "_all": F.sum("_in").over(by)})

    def ranks(kind: str, p: float) -> tuple[Column, Column, Column]:
        """First and second rank from 0, and the second's weight."""
        if kind == "disc":
            at = F.greatest(F.lit(1), F.col("_all") - F.floor(F.col("_all") - F.lit(float(p)) * F.col("_all"))) - 1
            return at, at, F.lit(0.0)
        at = F.lit(float(p)) * (F.col("_all") - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), ranks(*w)[side].cast("long").alias("rank"), ranks(*w)[2].alias("weight")) for name, w in wanted.items() for side in (0, 1)])
    # Partitions and keys of a range are known to hold together; a null key equals a null key.
    sought = ranges.select(*[F.col(n).alias(f"{n}r") for n in names], F.col("_part").alias("_at"), "_before", "_in", F.filter(asked, lambda x: (x.rank >= F.col("_before")) & (x.rank < F.col("_before") + F.col("_in"))).alias("_asked")).filter(F.size("_asked") > 0)
    near = present.join(sought, [F.col("_part") == F.col("_at"), *[F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names]])
    upto = F.sum("_n").over(W.partitionBy(*names, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
    hits = near.withColumn("_up", upto).select(*names, "_v", F.explode(F.filter("_asked", lambda x: (x.rank < F.col("_up")) & (x.rank >= F.col("_up") - F.col("_n")))).alias("_x"))
    # One row a key, name and side; groups without a value come from the keys alone.
    rows = hits.select(*names, "_v", "_x.*").unionByName(cells.select(*names).distinct(), allowMissingColumns=True)

    def out(name: str, kind: str) -> Column:
        lo, hi = (F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_v"))) for side in (0, 1))
        if kind == "disc":
            return lo.alias(name)
        w = F.max(F.when(F.col("name") == name, F.col("weight")))
        return F.when(lo == hi, lo.cast("double")).otherwise((1 - w) * lo + w * hi).alias(name)

    return rows.groupBy(*names).agg(*[out(name, w[0]) for name, w in wanted.items()]).withColumnsRenamed(dict(zip(names, keys)))


def approximate(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Sketch-based distinct count, quantiles and their mergeable states."""
    return df.groupBy(*group).agg(
        F.approx_count_distinct(value).alias("approx_distinct"), F.hll_sketch_estimate(F.hll_sketch_agg(value, 12)).alias("hll_distinct"),
        F.percentile_approx(value, 0.5, 10_000).alias("approx_median"), F.percentile_approx(value, 0.95, 10_000).alias("approx_p95"))


def approx_top_k(df: DataFrame, value: str, k: int, items: int = 10_000) -> DataFrame:
    """(item, count) of about the k most frequent values."""
    return df.select(F.expr(f"approx_top_k({value}, {k}, {items})").alias("t")).select(F.inline("t"))


def count_min(df: DataFrame, value: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    return df.agg(F.count_min_sketch(value, F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def binned_drift(a: DataFrame, b: DataFrame, bin_col: str) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein (in bins) and Jensen-Shannon distance of two histograms:
    both are counted first, the running sums go over one row a bin."""
    from pyspark.sql import Window as W

    counted = a.select(bin_col, F.lit(1.0).alias("x"), F.lit(0.0).alias("y")).unionByName(b.select(bin_col, F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    counted = counted.groupBy(bin_col).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    everything, upto = W.partitionBy(), W.orderBy(bin_col).rowsBetween(W.unboundedPreceding, 0)
    p = counted.select(bin_col, (F.col("x") / F.sum("x").over(everything)).alias("p"), (F.col("y") / F.sum("y").over(everything)).alias("q"))
    p = p.withColumns({"gap": F.abs(F.sum(F.col("p") - F.col("q")).over(upto)), "m": (F.col("p") + F.col("q")) / 2})
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.col("m"))).otherwise(0.0)
    return p.agg(F.max("gap").alias("ks"), F.sum("gap").alias("wasserstein"), (F.sum(part("p") + part("q")) / 2).alias("js"))
