"""MERGE, UPDATE, DELETE and upsert as new snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, key: list[str], update: dict[str, Column] | None = None,
          delete_when: Column | None = None, insert: bool = True) -> DataFrame:
    """The table after MERGE. Source columns are named ``s_<column>`` in the expressions; the
    source has at most one row a key. One full outer join."""
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("_s"))
    t = target.withColumn("_t", F.lit(True))
    cond = None
    for k in key:
        c = F.col(k) == F.col(f"s_{k}")
        cond = c if cond is None else cond & c
    both = t.join(s, cond, "full" if insert else "left")
    matched = F.col("_t").isNotNull() & F.col("_s").isNotNull()
    if delete_when is not None:
        both = both.filter(~(matched & F.coalesce(delete_when, F.lit(False))))
    update = {c: F.col(f"s_{c}") for c in target.columns if c in source.columns} if update is None else update
    out = []
    for c in target.columns:
        new = F.col(f"s_{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        out.append(F.when(F.col("_t").isNull(), new).when(matched, update.get(c, F.col(c))).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def upsert(target: DataFrame, source: DataFrame, key: list[str], do_nothing: bool = False) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE or DO NOTHING."""
    if do_nothing:
        return target.unionByName(source.join(target.select(*key), key, "left_anti"))
    return target.join(source.select(*key), key, "left_anti").select(*target.columns).unionByName(source)


def update(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.filter(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, mask: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the mask has are gone (a delete mask is such a list of row keys)."""
    return target.join(mask.select(*key).distinct(), key, "left_anti")
