"""Validation rules, column profiles and quality scores, in one pass of aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(kind: str, col: str, *args) -> Column:
    """A Column that is true where the row obeys the rule (null values obey all but not_null)."""
    c = F.col(col)
    checks = {
        "not_null": lambda: c.isNotNull(), "in_set": lambda: c.isin(*args), "regex": lambda: c.rlike(args[0]), "range": lambda: c.between(*args),
        "length": lambda: F.length(c).between(*args), "type": lambda: c.cast("string").try_cast(args[0]).isNotNull(), "email": lambda: c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "url": lambda: c.rlike(r"^[a-z][a-z0-9+.-]*://[^/\s]+"), "phone": lambda: c.rlike(r"^\+?[0-9 ().-]{7,20}$"),
        "date_format": lambda: F.try_to_timestamp(c, F.lit(args[0])).isNotNull(), "expression": lambda: F.expr(args[0])}
    ok = checks[kind]()
    return ok if kind == "not_null" else F.coalesce(ok, c.isNull())


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, passed, failed) of all rules in one pass."""
    agg = df.agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(F.when(r, 0).otherwise(1)), F.lit(0)).alias(n) for n, r in rules.items()])
    out = F.array(*[F.struct(F.lit(n).alias("rule"), (F.col("_n") - F.col(n)).cast("long").alias("passed"), F.col(n).cast("long").alias("failed")) for n in rules])
    return agg.select(F.inline(out))


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def foreign_key_violations(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).join(parent.select(F.col(parent_col).alias(col)).distinct(), col, "left_anti")


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, n, nulls, distinct_n, min, max) of columns in one pass; numbers as text."""
    aggs = [F.count("*").alias("_n")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__c"), F.count_distinct(c).alias(f"{c}__d"), F.min(c).cast("string").alias(f"{c}__lo"), F.max(c).cast("string").alias(f"{c}__hi")]
    rows = F.array(*[F.struct(
        F.lit(c).alias("name"), F.col("_n").alias("n"), (F.col("_n") - F.col(f"{c}__c")).alias("nulls"), F.col(f"{c}__d").alias("distinct_n"),
        F.col(f"{c}__lo").alias("min"), F.col(f"{c}__hi").alias("max")) for c in cols])
    return df.agg(*aggs).select(F.inline(rows))


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


def quality_score(df: DataFrame, cols: list[str], rules: dict[str, Column]) -> DataFrame:
    """Completeness of each column (weight 0.3), pass rate of the rules (0.4) and mean share of
    distinct values (0.3), over the total weight."""
    n = F.count("*")
    full = sum((F.count(c) * 100.0 / n for c in cols), F.lit(0.0))
    passed = sum((F.sum(F.when(r, 1.0).otherwise(0.0)) / n for r in rules.values()), F.lit(0.0)) * (100.0 / max(len(rules), 1))
    distinct = sum((F.count_distinct(c) * 100.0 / n for c in cols), F.lit(0.0)) / max(len(cols), 1)
    weight = 0.3 * len(cols) + (0.4 if rules else 0.0) + 0.3
    return df.agg(((0.3 * full + (0.4 * passed if rules else F.lit(0.0)) + 0.3 * distinct) / weight).alias("score"))


def transforms(df: DataFrame, col: str) -> DataFrame:
    """Standard and min-max scaled values, the log, and a hash bucket of a number column."""
    s = df.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"), F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    c = F.col(col)
    return df.join(s).withColumns({
        "standard": F.try_divide(c - F.col("_m"), F.col("_s")), "minmax": F.try_divide(c - F.col("_lo"), F.col("_hi") - F.col("_lo")),
        "log1p": F.when(c > -1, F.log1p(c)), "hash_bucket": F.pmod(F.xxhash64(c), F.lit(16)).cast("int")}).drop("_m", "_s", "_lo", "_hi")
