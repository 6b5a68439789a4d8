"""Connected components of an edge table, as joins and aggregations over the whole cluster.

Labels are the smallest node of a component. Edges are first contracted inside each partition
(a spanning forest of its own edges), then alternate large-star and small-star steps run until
nothing changes; the number of steps grows with the logarithm of the longest path. Each step is
written to the shared folder and deleted after the next one. No neighbour list is gathered: a node's
edges are aggregated with partial sums, and the edges of hubs (nodes with more than one in ``HUBS`` of
all edges, so at most twice as many nodes as that) meet their minimum where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, written

#: Edges that a worker contracts at once.
FOREST_EDGES = 500_000
#: A node with more than one in so many edges counts as a hub: there are 2 * HUBS of them at most.
HUBS = 500


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    n = 0

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def out():
        rows = [(x, root(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        n += batch.num_rows
        if n >= FOREST_EDGES:
            yield from out()
            n = 0
    yield from out()


def _star(edges: DataFrame, n_edges: int, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node points to the smallest of the node and its
    neighbours. Small star: so do the node and its smaller neighbours."""
    there = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sides = there.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else there
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
    hubs = F.broadcast(least.filter(F.col("degree") * HUBS > n_edges).select("u", "m"))
    joined = sides.join(hubs, "u").unionByName(sides.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its smallest node."""
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    now = written(both.mapInArrow(_forest, "a long, b long"), "forest")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        # stars: each node has one edge, to a node that has none to a smaller one
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._gridloom_path = now._gridloom_path
            return out
        seen = (state["n"], state["h"])
        before, half = now, written(_star(now, state["n"], large=True), "half")
        now = written(_star(half, half.count(), large=False), "stars")
        discard(before, half)
