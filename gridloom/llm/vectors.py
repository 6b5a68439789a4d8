"""Vectors for the search operators: which take part, tiles of query blocks and shards, merging."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a tile, queries whose scores are held at once, partial lists that one step of the merge joins.
QUERY_ROWS, SHARD_ROWS, AT_ONCE, FAN = 2048, 8192, 256, 64


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part, finite, not empty, not zero unless allowed; and more columns."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = rows.filter(finite)
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows


def common_length(rows: DataFrame) -> tuple[int, int]:
    """The most common number of components (the larger one of two) and how many rows have it."""
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (found["d"], found["count"]) if found else (0, 0)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sorted_rows(part: pa.Table, *more: str) -> tuple[np.ndarray, ...]:
    """Ids, vectors and further columns of a tile's side, whose vectors are of one length, sorted by id and vector."""
    ids, v = part.column("vec_id").to_numpy(), matrix(part.column("v"), len(part.column("v")[0]))
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*v.T[::-1], ids))
    return (ids[order], v[order], *(np.array(part.column(c).to_pylist(), dtype=object)[order] for c in more))


def first_of_each(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows that repeat an id the first."""
    keep = np.r_[True, np.diff(ids) != 0]
    return ids[keep], v[keep]


def tiles(rows: DataFrame, asking: DataFrame, n_rows: int, n_queries: int, query_rows: int, shard_rows: int) -> tuple[DataFrame, int]:
    """Each query block with each shard: the rows of a tile share (dim, block, shard), queries are marked.

    A row is copied once for each query block and a query once for each shard; both counts follow
    from the sizes of the two sides, and a tile has about query_rows + shard_rows rows. Vectors meet
    those of their own length only."""
    blocks, shards = max(1, math.ceil(n_queries / query_rows)), max(1, math.ceil(n_rows / shard_rows))
    own_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    own_shard = F.pmod(F.xxhash64("vec_id", "v", F.lit(2)), F.lit(shards)).cast("int")
    data = rows.withColumns({"dim": F.size("v"), "is_query": F.lit(False), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "shard": own_shard})
    ask = asking.withColumns({"dim": F.size("v"), "is_query": F.lit(True), "block": own_block, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    return data.unionByName(ask, allowMissingColumns=True), shards


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, ties to earlier places; not in order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = -np.partition(-scores, k - 1)[k - 1]
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]


def by_tile(tiled: DataFrame, search: Callable, score_type: str) -> DataFrame:
    """search(queries table, rows table) -> (query_id, vec_id, score) arrays, in each tile."""

    def run(key, part):
        mark = part.column("is_query")
        ask, data = part.filter(mark), part.filter(pa.compute.invert(mark))
        q, v, s = search(ask, data) if ask.num_rows and data.num_rows else ([], [], [])
        kind = pa.float64() if score_type == "double" else pa.int64()
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, kind), "shard": pa.array([key[2].as_py()] * len(q), pa.int32())})

    import pyarrow.compute  # noqa: F401

    return tiled.groupBy("dim", "block", "shard").applyInArrow(run, f"query_id long, vec_id long, score {score_type}, shard int")


def merged(found: DataFrame, k: int, shards: int) -> DataFrame:
    """The k best of each query, nearest first, ties to the smaller id; lists are merged in a tree."""
    order = [F.desc("score"), F.asc("vec_id")]
    nodes = shards
    while nodes > 1:
        nodes = math.ceil(nodes / FAN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))).filter(F.col("rank") <= k)
        if nodes == 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
