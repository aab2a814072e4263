"""The corpus pipeline: toxicity, near-dedup, PII, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwell.llm import common, mixing, near_dedup, packing, pii, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The learned and random stages can't be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
