"""URL filtering by host-suffix and path-prefix expressions.

Each URL becomes the expressions (host suffix + path prefix) that a rule could name. Their
SHA-256 digests meet the rules' digests in an equi-join on a short prefix; the full digest is
then compared, and the most specific rule wins (longest expression, then longest host, then
block before allow). Only suffixes of as many labels and prefixes of such lengths as occur
among the rules are made, which loses no rule and bounds the expansion by the rules.

Cases: a null url, or one without "://", has an empty host and path and no rule fits it;
the verdict is then the default. Null ids, repeated rows and extra columns are kept as rows
of the input; repeated urls are judged once. An empty table gives an empty result, and no
rules give every url the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (action, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
PREFIX_BYTES = 4
#: The rules are broadcast up to this many, else the join shuffles.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
          broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns that have these names already are
    replaced, all others stay."""
    expr = F.concat("host", "path")
    named = rules.filter("host is not null and path is not null").select(
        expr.alias("rule"), "action", F.length("host").alias("host_len"),
        F.sha2(F.concat_ws("\x00", "host", "path"), 256).alias("digest"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"),
    ).distinct()
    shape = named.agg(F.count("*"), F.max("labels"), F.array_sort(F.collect_set("path_len"))).head()
    n_rules, labels, lengths = shape[0], shape[1] or 1, list(shape[2] or [0])
    pages = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    part = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(part), F.lit(labels))),
        lambda k: F.array_join(F.slice(part, -k, k), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    candidates = (
        pages.filter(F.col("host") != "").select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .select("host", "path", F.sha2(F.concat_ws("\x00", "suffix", "prefix"), 256).alias("seen"))
        .withColumn("short", F.substring("seen", 1, 2 * PREFIX_BYTES))
    )
    named = named.withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    if n_rules <= broadcast_rules:
        hits = candidates.join(F.broadcast(named), "short").filter(F.col("seen") == F.col("digest"))
    else:
        # Every page of a top-level domain has the same expression: each is compared once.
        once = candidates.select("short", "seen").distinct()
        fit = once.join(named, "short").filter(F.col("seen") == F.col("digest")).drop("short", "digest")
        hits = candidates.drop("short").join(fit, "seen")
    action, h, p_ = common.fresh(pages.columns, "_action", "_h", "_p")
    best = (
        hits.groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), "host_len", F.col("action") == "block", "rule", "action")).alias("top"))
        .select(F.col("host").alias(h), F.col("path").alias(p_), F.col("top.rule").alias("rule"),
                F.col("top.action").alias(action))
    )
    return (
        pages.drop("rule", "verdict").join(best, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p_)), "left")
        .withColumn("verdict", F.coalesce(action, F.lit(default)))
        .drop(h, p_, action)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, rules_frame(spark, RULES))
    # The rule is shown as in a rule list: host and path joined.
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL
         ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.action, row_number() OVER (
    PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
