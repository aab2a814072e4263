"""Revenue by market segment: scan, pushed filter, two joins, aggregate, top rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, query

ORACLE = """
SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment
"""


@query("flagship_segment_revenue", ORACLE)
def build(t: Tables) -> DataFrame:
    lines = t.lineitem.filter("l_shipdate >= timestamp_ntz '1995-01-01'")
    # Lines are summed by order before they meet orders and customers.
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count("*").alias("k"))
    return (
        per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("k").alias("n"))
    )


def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(Tables(spark, sf_dir)).orderBy("c_mktsegment")
