"""Property-graph operators over an edge table (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.rows import missing_from


def neighbours(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges of the given nodes with their targets, of one relation if named."""
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    return e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))


def reach(edges: DataFrame, start: DataFrame, depth: int, both_ways: bool = False) -> DataFrame:
    """(node, depth): nodes within `depth` steps of the start nodes, with the fewest steps. One join for each step."""
    e = edges.select("src", "dst")
    if both_ways:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = front = start.select("node", F.lit(0).alias("depth"))
    for step in range(1, depth + 1):
        front = front.join(e, front.node == e.src).select(F.col("dst").alias("node"), F.lit(step).alias("depth")).distinct()
        front = missing_from(front, found, ["node"])
        found = found.unionByName(front)
    return found


def upsert_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (src, dst, relation): incoming rows win."""
    keys = ["src", "dst", "relation"]
    return missing_from(edges, incoming, keys).unionByName(incoming.dropDuplicates(keys))
