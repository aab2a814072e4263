"""Time series over (series, ts, value) rows; ``ts`` is a long of milliseconds or any number
unless a name says otherwise. Every operator is one shuffle by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(ts: str, width: int) -> Column:
    return (F.floor(F.col(ts) / width) * width).cast("long")


def aggregate(df: DataFrame, series: list[str], ts: str, value: str, width: int) -> DataFrame:
    """sum, avg, min, max, count, first, last, stddev and variance (population), rate
    ((last - first) / count), increase and delta by bucket."""
    g = df.groupBy(*series, bucket(ts, width).alias("bucket")).agg(
        F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("count"), F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"),
        F.stddev_pop(value).alias("stddev"), F.var_pop(value).alias("variance"))
    return g.withColumns({
        "rate": (F.col("last") - F.col("first")) / F.col("count"), "delta": F.col("last") - F.col("first"),
        "increase": F.greatest(F.col("last") - F.col("first"), F.lit(0.0))})


def percentile(df: DataFrame, series: list[str], ts: str, value: str, width: int, p: float) -> DataFrame:
    """sorted[floor(p/100 * (n-1))] by bucket, without interpolation."""
    at = F.floor(F.lit(p / 100.0) * (F.size("_v") - 1)).cast("int")
    g = df.groupBy(*series, bucket(ts, width).alias("bucket")).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return g.withColumn("value", F.get("_v", at)).drop("_v")


def downsample(df: DataFrame, series: list[str], ts: str, value: str, width: int, how: str = "avg") -> DataFrame:
    return aggregate(df, series, ts, value, width).select(*series, "bucket", F.col(how).alias("value"))


def rate(df: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """Change a second against the row before (0 where time stands still); the first row goes."""
    w = W.partitionBy(*series).orderBy(ts)
    dt = (F.col(ts) - F.lag(ts).over(w)) / 1000.0
    dv = F.col(value) - F.lag(value).over(w)
    out = df.withColumns({"_dt": dt, "_dv": dv}).filter("_dt is not null")
    return out.withColumn("rate", F.when(F.col("_dt") > 0, F.col("_dv") / F.col("_dt")).otherwise(0.0)).drop("_dt", "_dv")


derivative = rate


def integral(df: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """Running sum of the values."""
    w = W.partitionBy(*series).orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("integral", F.sum(value).over(w))


def moving_average(df: DataFrame, series: list[str], ts: str, value: str, n: int) -> DataFrame:
    """Mean of the last n rows, fewer at the start."""
    w = W.partitionBy(*series).orderBy(ts).rowsBetween(-(n - 1), W.currentRow)
    return df.withColumn("moving_average", F.avg(value).over(w))


def exponential_moving_average(df: DataFrame, series: list[str], ts: str, value: str, alpha: float) -> DataFrame:
    """alpha*x + (1-alpha)*ema, from the first value on. A series is gathered in order into one
    array (it must fit a task) and folded there, without Python."""
    g = df.groupBy(*series).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v")))).alias("a"))
    fold = F.aggregate(
        "a", F.array().cast("array<struct<t:bigint,v:double,e:double>>"),
        lambda s, x: F.array_append(s, F.struct(
            x.t.cast("long").alias("t"), x.v.alias("v"),
            F.when(F.size(s) == 0, x.v).otherwise(alpha * x.v + (1 - alpha) * F.element_at(s, -1).e).alias("e"))))
    return g.select(*series, F.inline(fold).alias(ts, value, "ema"))


def gap_fill(df: DataFrame, series: list[str], ts: str, value: str, step: int, how: str = "linear", constant: float = 0.0) -> DataFrame:
    """A row at each step from a series' first to its last time. ``how``: null, previous, next,
    linear (by time), constant, average (of the neighbours)."""
    span = df.groupBy(*series).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    spine = span.select(*series, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("long"))).alias(ts))
    both = spine.join(df.select(*series, ts, F.col(value).alias("_v")), [*series, ts], "left")
    back = W.partitionBy(*series).orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*series).orderBy(ts).rowsBetween(W.currentRow, W.unboundedFollowing)
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")))
    both = both.withColumns({"_p": F.last(known, True).over(back), "_n": F.first(known, True).over(ahead)})
    p, n = F.col("_p.v"), F.col("_n.v")
    fill = {
        "null": F.lit(None).cast("double"), "previous": p, "next": n, "constant": F.lit(float(constant)), "average": (p + n) / 2,
        "linear": p + (n - p) * (F.col(ts) - F.col("_p.t")) / F.nullif(F.col("_n.t") - F.col("_p.t"), F.lit(0)),
    }[how]
    return both.select(*series, ts, F.coalesce("_v", fill).alias(value), F.col("_v").isNull().alias("filled"))


def detect_anomalies(df: DataFrame, series: list[str], value: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose |z| exceeds the threshold (population deviation; three rows at least)."""
    s = df.groupBy(*series).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_c"))
    out = df.join(s.filter("_c >= 3 and _s > 0"), series)
    return out.withColumn("zscore", (F.col(value) - F.col("_m")) / F.col("_s")).filter(F.abs("zscore") > threshold).drop("_m", "_s", "_c")


def forecast(df: DataFrame, series: list[str], ts: str, value: str, horizon: int) -> DataFrame:
    """Line through (row index, value), continued; the step is the first gap."""
    w = W.partitionBy(*series).orderBy(ts)
    rows = df.withColumns({"_i": (F.row_number().over(w) - 1).cast("double"), "_gap": F.lead(ts).over(w) - F.col(ts)})
    g = rows.groupBy(*series).agg(
        F.regr_slope(value, "_i").alias("_a"), F.regr_intercept(value, "_i").alias("_b"), F.count("*").alias("_n"),
        F.max(ts).alias("_last"), F.min_by("_gap", "_i").alias("_step"))
    g = g.filter("_n >= 2").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return g.select(*series, (F.col("_last") + F.col("_step") * F.col("_k")).alias(ts), (F.col("_b") + F.col("_a") * (F.col("_n") - 1 + F.col("_k"))).alias(value))


def decompose(df: DataFrame, series: list[str], ts: str, value: str, period: int) -> DataFrame:
    """Trailing mean, what remains, and a residual of zero."""
    out = moving_average(df, series, ts, value, period).withColumnRenamed("moving_average", "trend")
    return out.withColumns({"seasonal": F.col(value) - F.col("trend"), "residual": F.lit(0.0)})
