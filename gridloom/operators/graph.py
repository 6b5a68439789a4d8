"""Connected components of an edge table, as joins and aggregations over the whole cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of these."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(rest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its smallest node.

    Alternating star steps end when each node has one edge, to a node without a smaller neighbour;
    their number grows with the logarithm of the longest path. Each pair of steps is written to the
    shared folder, so lineage stays short and lost executors cost one step."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not state[0] or state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        now = written(_small_star(_large_star(now).filter("a <> b")), "stars")
