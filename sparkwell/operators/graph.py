"""Graphs as edges (src, dst[, weight]). Loops write each step to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint


def neighbors(edges: DataFrame, node, direction: str = "outgoing") -> DataFrame:
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("node"))
    back = edges.filter(F.col("dst") == node).select(F.col("src").alias("node"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction].distinct()


def bfs(edges: DataFrame, start, max_depth: int) -> DataFrame:
    """(node, depth) of all nodes within max_depth steps of start."""
    links = checkpoint(edges.select("src", "dst").distinct())
    kind = links.schema["src"].dataType
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(links, front.node == links.src).select(F.col("dst").alias("node")).distinct()
        front = checkpoint(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.head(1):
            break
        seen = checkpoint(seen.unionByName(front))
    return seen


def shortest_path(edges: DataFrame, start) -> DataFrame:
    """(node, cost, path) from start by weight (non-negative, else an error); of equal costs the
    least path. Rounds go on until no cost falls."""
    links = checkpoint(edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight")))
    if links.filter("weight < 0").head(1):
        raise ValueError("weights must not be negative")
    kind = links.schema["src"].dataType
    spark = edges.sparkSession
    first = F.lit(start).cast(kind)
    best = checkpoint(spark.range(1).select(first.alias("node"), F.lit(0.0).alias("cost"), F.array(first).alias("path")))
    front = best
    while True:
        # Only nodes whose cost fell are expanded again.
        step = front.join(links, front.node == links.src).select(
            F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("new"))
        old = best.select("node", F.col("cost").alias("_c"))
        front = checkpoint(step.join(old, "node", "left").filter("_c is null or new.cost < _c").select("node", "new.cost", "new.path"))
        if not front.head(1):
            return best
        best = checkpoint(best.join(front, "node", "left_anti").unionByName(front))


def all_paths(edges: DataFrame, start, goal, max_nodes: int) -> DataFrame:
    """Simple directed paths of at most max_nodes nodes."""
    links = edges.select("src", "dst").distinct()
    first = F.lit(start).cast(links.schema["src"].dataType)
    front = edges.sparkSession.range(1).select(first.alias("node"), F.array(first).alias("path"))
    found = front.filter(F.col("node") == goal)
    for _ in range(max_nodes - 1):
        front = front.filter(F.col("node") != goal).join(links, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(
            F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = checkpoint(front)
        if not front.head(1):
            break
        found = found.unionByName(front.filter(F.col("node") == goal))
    return found.select("path")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank): (1-d)/n + d * sum of rank/outdegree; parallel edges count once, mass of
    nodes without out-edges is not handed on."""
    links = checkpoint(edges.select("src", "dst").distinct())
    nodes = checkpoint(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    out = links.groupBy("src").agg(F.count("*").alias("deg"))
    links = checkpoint(links.join(out, "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        ranks = checkpoint(nodes.join(given, F.col("node") == F.col("dst"), "left").select(
            "node", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each undirected component. Labels spread over
    edges and, by following the label's own label, jump ahead, so long chains take few rounds; the
    rounds go on until no label changes."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("component")))
    while True:
        seen = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("c"))
        near = labels.join(seen, F.col("node") == F.col("src"), "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("_was"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_up"))
        near = near.join(jump, F.col("component") == F.col("_n"), "left").select(
            "node", F.least("component", F.coalesce("_up", "component")).alias("component"), "_was")
        near = checkpoint(near)
        changed = near.filter("component <> _was").head(1)
        labels = near.select("node", "component")
        if not changed:
            return labels


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): all nodes take the most frequent label among their neighbours at
    once, the least on a tie."""
    both = checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("dst") == F.col("node")).groupBy("src", "community").agg(F.count("*").alias("k"))
        top = votes.groupBy("src").agg(F.max("k").alias("m"))
        best = votes.join(top, "src").filter("k = m").groupBy(F.col("src").alias("node")).agg(F.min("community").alias("community"))
        labels = checkpoint(best)
    return labels


def stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges and average degree 2E/N."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    count = edges.agg(F.count("*").alias("edges"))
    return nodes.join(count).withColumn("avg_degree", F.try_divide(2 * F.col("edges"), F.col("nodes")))
