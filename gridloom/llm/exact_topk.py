"""Operator 9: exact top-k search by tiled matrix products.

Components become floor(256 * x). Query blocks meet shards in tiles of bounded size; a tile is
matrix products, from which each query's k best are selected, and the lists of the tiles are merged
in a tree. Products and sums are exact: they are formed in doubles where no sum can reach 2^53, and
in whole numbers elsewhere; a score beyond a long is an error.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows without
an id take no part; vectors are compared with those of their own length; rows that repeat an id are
candidates each for themselves, but never for a query of their id, and of queries that repeat an id
the one with the smallest vector asks; ties go to the smaller id; an empty table, or one row, gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.vectors import AT_ONCE, QUERY_ROWS, SHARD_ROWS, best, by_tile, first_of_each, merged, sorted_rows, tiles, usable

SCALE = 256.0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held in doubles."""
    bound = (np.abs(a).max() if a.size else 0) * (np.abs(b).max() if b.size else 0) * max(1, a.shape[1])
    if bound < 2**53:
        return a @ b.T
    rows, columns = [list(map(int, r)) for r in a], [list(map(int, r)) for r in b]
    exact = [[sum(x * y for x, y in zip(r, c, strict=True)) for c in columns] for r in rows]
    if any(not -(2**63) <= x < 2**63 for r in exact for x in r):
        raise OverflowError("a score does not fit into a long")
    return np.array(exact, dtype=np.int64).reshape(len(rows), len(columns))


def _search(k: int):
    def run(ask, data):
        q_ids, q = first_of_each(*sorted_rows(ask))
        ids, v = sorted_rows(data)
        v = np.floor(SCALE * v)
        out_q, out_v, out_s = [], [], []
        own, end = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
        for low in range(0, len(q_ids), AT_ONCE):
            scores = products(np.floor(SCALE * q[low : low + AT_ONCE]), v)
            for i, row in enumerate(scores, low):
                at = best(row, k + end[i] - own[i])
                at = at[ids[at] != q_ids[i]]
                if len(at) > k:
                    at = at[np.lexsort((ids[at], -row[at]))[:k]]
                out_q.append(np.full(len(at), q_ids[i]))
                out_v.append(ids[at])
                out_s.append(row[at].astype(np.int64))
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (long) of each query's k best; is_query refers to vec_id."""
    rows = usable(vectors, id_col, vector_col, zero=True)
    asking = rows.filter(is_query)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    tiled, shards = tiles(rows, asking, n, n_queries, query_rows, shard_rows)
    return merged(by_tile(tiled, _search(k), "long"), k, shards)


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
