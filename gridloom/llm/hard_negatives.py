"""Operator 11: hard negatives by vantage-point trees over norm-augmented vectors.

Components become floor(256 * x). A vector v gets one more component, sqrt(M^2 - |v|^2) with M the
largest norm of the table, and an anchor a gets zero there; then |v' - a'|^2 = M^2 + |a|^2 - 2 a.v, so
the nearest rows have the highest scores, and a window of scores is an annulus around the anchor.

The top of the tree, ``MAX_CELLS`` cells at most, is built on a bounded sample and broadcast; every
row is routed to its cell. An anchor visits the cells that its ball or annulus can reach. What it has
to reach is bounded beforehand by the rows of the sample that qualify, which are rows of the table
themselves: nothing farther than the k-th of them can be among the k nearest. In a cell a tree is
built over its rows, and its leaves are visited nearest first until k rows that qualify are nearer
than anything left, or the annulus ends. Distances only steer the search, with a margin for their
rounding: scores, windows and ties are decided on whole numbers.

The positives of an anchor, and then its negatives for each positive, are two such searches. A group
of one task is a part of a cell (``SHARD_ROWS`` rows, dealt by a hash, so that a cell of copies is
spread) with ``QUERY_ROWS`` queries; lists of the parts are merged by rank in a tree.

Defined results: rows with a null id, a null label, a null or empty vector or a null or non-finite
component take no part; vectors are compared with those of their own length; rows that repeat an id
are candidates each for themselves, but never for an anchor of their id, and of anchors that repeat
an id the one with the smallest vector, then label, asks; ties go to the smaller id; an anchor without
positives, and a positive with an empty window (as with negative scores), give no rows; an empty table
gives no rows; other columns are ignored; a score beyond a long is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import discard, small_batches, table, written
from gridloom.llm.exact_topk import SCALE, products
from gridloom.llm.vectors import AT_ONCE, FAN, common_length, matrix, usable

SAMPLE_ROWS, MAX_CELLS = 8192, 4096
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 8192, 64
#: Vectors of other lengths than the most common one share this many cells, without a tree above them.
OTHER_CELLS = 64
#: A query that is a row of the table: its window of scores, whose label qualifies, and who asks.
QUERY = "query long, vec_id long, label long, v array<double>, low long, high long"
LOWEST = -(2**63)


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))[:, None]], 1)


@dataclass
class Tree:
    """Inner nodes in breadth-first order (children of i: 2i+1, 2i+2), all leaves on one level."""

    points: np.ndarray  # vantage points, (nodes, d + 1)
    radius: np.ndarray
    near: np.ndarray  # distances of rows inside: least and most, then the same outside
    depth: int

    def route(self, rows: np.ndarray) -> np.ndarray:
        """Number of the leaf of each (augmented) row."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(((rows - self.points[node]) ** 2).sum(1))
            node = 2 * node + 1 + (d > self.radius[node])
        return node - (2**self.depth - 1)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each leaf's rows from each query, by the triangle inequality."""
        low, high = np.zeros((len(queries), 1)), np.full((len(queries), 1), np.inf)
        for level in range(self.depth):
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            sq = (queries**2).sum(1)[:, None] + (self.points[at] ** 2).sum(1) - 2 * queries @ self.points[at].T
            d = np.sqrt(np.maximum(sq, 0))[:, :, None]
            near = self.near[at].reshape(-1, 2, 2)
            low = np.maximum(low[:, :, None], np.maximum(near[:, :, 0] - d, d - near[:, :, 1])).reshape(len(queries), -1)
            high = np.minimum(high[:, :, None], d + near[:, :, 1]).reshape(len(queries), -1)
        return low, high


def grown(rows: np.ndarray, depth: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree of augmented rows and the rows of its leaves; halves are of equal size whatever the ties."""
    nodes = 2**depth - 1
    points, radius, near = np.zeros((nodes, rows.shape[1])), np.zeros(nodes), np.zeros((nodes, 4))
    parts = [np.arange(len(rows))]
    for i in range(nodes):
        own = parts[i]
        if not len(own):
            near[i] = np.inf, -np.inf, np.inf, -np.inf
            parts += [own, own]
            continue
        start = ((rows[own] - rows[own[0]]) ** 2).sum(1)
        points[i] = rows[own[start.argmax()]]
        d = np.sqrt(((rows[own] - points[i]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = (len(own) + 1) // 2
        inner, outer = order[:half], order[half:]
        radius[i] = d[inner[-1]]
        near[i] = d[inner[0]], d[inner[-1]], *((d[outer[0]], d[outer[-1]]) if len(outer) else (np.inf, -np.inf))
        parts += [own[np.sort(inner)], own[np.sort(outer)]]
    return Tree(points, radius, near, depth), parts[nodes:]


@dataclass
class Top:
    """What every task knows: the upper tree over the most common length, and the sample."""

    tree: Tree
    dim: int
    most: float  # square of the largest norm
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray


def top_of(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: float, cells: int, dim: int) -> Top:
    depth = max(0, math.ceil(math.log2(cells))) if len(ids) else 0
    tree, _ = grown(augmented(v, most) if len(ids) else np.zeros((0, dim + 1)), depth)
    # rows that are not in the sample reach beyond its least and greatest distances: of a cell only the radius is sure
    tree.near = np.stack([np.zeros(len(tree.radius)), tree.radius, tree.radius, np.full(len(tree.radius), np.inf)], 1)
    return Top(tree, dim, most, ids, labels, v)


def _margin(most: float, norms: np.ndarray) -> np.ndarray:
    return 1e-9 * (most + norms) + 1.0


def scores_within(low: np.ndarray, high: np.ndarray, norms: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of rows between two distances from queries of given squared norms, with a margin."""
    total, margin = (most + norms)[:, None], _margin(most, norms)[:, None]
    least = np.where(np.isfinite(high), (total - np.where(np.isfinite(high), high, 0) ** 2) / 2 - margin, -np.inf)
    greatest = np.where(np.isfinite(low), (total - np.where(np.isfinite(low), low, 0) ** 2) / 2 + margin, -np.inf)
    return least, greatest


def merge(scores: np.ndarray, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of both, ties to smaller ids."""
    s = np.concatenate([best[0], scores], 1)
    i = np.concatenate([best[1], np.broadcast_to(ids, scores.shape)], 1)
    order = np.lexsort((i, -s.astype(float) if np.abs(s[s > LOWEST]).max(initial=0) < 2**53 else np.where(s > LOWEST, -s, 2**63 - 1)), axis=-1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


@dataclass
class Queries:
    ids: np.ndarray  # of the anchor
    labels: np.ndarray
    v: np.ndarray
    low: np.ndarray  # window of scores
    high: np.ndarray
    same: bool  # rows of the same label qualify, or those of others

    def some(self, at: np.ndarray) -> Queries:
        return Queries(self.ids[at], self.labels[at], self.v[at], self.low[at], self.high[at], self.same)

    def qualified(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Scores of rows that qualify, LOWEST elsewhere."""
        s = products(self.v, v).astype(np.int64)
        right = (labels == self.labels[:, None]) == self.same
        return np.where(right & (ids != self.ids[:, None]) & (s >= self.low[:, None]) & (s <= self.high[:, None]), s, LOWEST)


def search(q: Queries, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: float, k: int, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids (queries, k) of the best rows that qualify, and how many scores were formed.

    Every query visits leaves nearest first; in each round the queries whose next leaf is the same one share a product."""
    n = len(q.ids)
    best = np.full((n, k), LOWEST, np.int64), np.full((n, k), 2**63 - 1, np.int64)
    tree, leaves = grown(augmented(v, most), max(0, math.ceil(math.log2(max(1, len(ids) / leaf_rows)))))
    norms = (q.v * q.v).sum(1)
    least, greatest = scores_within(*tree.bounds(np.concatenate([q.v, np.zeros((n, 1))], 1)), norms, most)
    order = np.argsort(-greatest, axis=1, kind="stable")
    formed = 0
    going = np.arange(n)
    for at in range(len(leaves)):
        leaf = order[going, at]
        # leaves come by falling greatest score: below the window, or below the k-th found, none of the rest counts
        ahead = greatest[going, leaf] >= np.maximum(q.low[going].astype(float), best[0][going, -1].astype(float))
        going, leaf = going[ahead], leaf[ahead]
        if not len(going):
            break
        reached = least[going, leaf] <= q.high[going]
        for x in np.unique(leaf[reached]):
            rows, asking = leaves[x], going[reached & (leaf == x)]
            if not len(rows):
                continue
            s = q.some(asking).qualified(ids[rows], labels[rows], v[rows])
            formed += s.size
            better = ((s > LOWEST) & (s >= best[0][asking, -1:])).any(1)
            if better.any():
                at_best = asking[better]
                best[0][at_best], best[1][at_best] = merge(s[better], ids[rows], (best[0][at_best], best[1][at_best]), k)
    return *best, formed


def _route(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy()
            cell = -1 - size.astype(np.int64) % OTHER_CELLS
            common = np.flatnonzero(size == top.dim)
            if len(common):
                cell[common] = top.tree.route(augmented(matrix(batch.column(2).take(pa.array(common)), top.dim), top.most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(cell, pa.int32())], [*batch.schema.names, "dim", "cell"])

    return run


def reachable(top: Top, q: Queries, k: int) -> np.ndarray:
    """Which cells (queries, cells) may hold one of the k best: k rows of the sample that qualify bar all that is farther."""
    bar = q.low.astype(float)
    if len(top.ids) >= k:
        bar = np.maximum(bar, np.partition(q.qualified(top.ids, top.labels, top.v), len(top.ids) - k, axis=1)[:, -k].astype(float))
    least, greatest = scores_within(*top.tree.bounds(np.concatenate([q.v, np.zeros((len(q.ids), 1))], 1)), (q.v * q.v).sum(1), top.most)
    return (greatest >= bar[:, None]) & (least <= q.high[:, None])


def _visits(shared, k: int, same: bool):
    """The cells that each query has to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for batch in batches:
            size = pc.list_value_length(batch.column("v")).to_numpy()
            cells: list = [[-1 - int(s) % OTHER_CELLS] for s in size]
            common = np.flatnonzero(size == top.dim)
            if len(common):
                q = queries_of(batch.take(pa.array(common)), same)
                for low in range(0, len(common), AT_ONCE):
                    at = np.arange(low, min(low + AT_ONCE, len(common)))
                    for i, row in zip(common[at], reachable(top, q.some(at), k), strict=True):
                        cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "dim", "cells"])

    return run


def queries_of(part: pa.Table | pa.RecordBatch, same: bool) -> Queries:
    def of(name: str) -> np.ndarray:
        return part.column(name).to_numpy()

    v = part.column("v")
    return Queries(of("vec_id"), of("label"), matrix(v, len(v[0])), of("low"), of("high"), same)


def _in_tile(shared, k: int, same: bool, leaf_rows: int):
    def run(key, part):
        top, mark = shared.value, pc.is_valid(part.column("query"))
        asking, rows = part.filter(mark), part.filter(pc.invert(mark))
        if not asking.num_rows or not rows.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        q = queries_of(asking, same)
        ids = rows.column("vec_id").to_numpy()
        v = matrix(rows.column("v"), q.v.shape[1])
        score, found, _ = search(q, ids, rows.column("label").to_numpy(), v, top.most, k, leaf_rows)
        at = np.nonzero(score > LOWEST)
        node = (key[1].as_py() + OTHER_CELLS) * FAN**3 + key[2].as_py()
        return pa.table({"query": asking.column("query").to_numpy()[at[0]], "id": found[at], "score": score[at], "node": np.full(len(at[0]), node, np.int64)})

    return run


def best_by_query(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all tiles, ranked; lists are merged in a tree."""
    order = [F.desc("score"), F.asc("id")]
    for spread in (FAN, 1):
        group = ["query", F.pmod("node", F.lit(spread)).alias("g")] if spread > 1 else ["query"]
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("query", "rank", "id", "score")


def _searched(rows: DataFrame, asking: DataFrame, shared, k: int, same: bool, sizes: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """query, rank, id and score of the k best rows of each query (columns of QUERY), and a work table that this reads."""
    shard_rows, query_rows, leaf_rows = sizes
    schema = f"{QUERY}, dim int, cells array<int>"
    visits = written(asking.select(*(c.split()[0] for c in QUERY.split(", "))).mapInArrow(_visits(shared, k, same), schema), "visits")
    per_cell = visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    # at most MAX_CELLS + OTHER_CELLS rows of three numbers
    plan = F.broadcast(per_cell.join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("held")), "cell").select(
        "cell", F.ceil(F.col("held") / shard_rows).cast("int").alias("chunks"), F.ceil(F.col("asked") / query_rows).cast("int").alias("blocks")
    ))
    own_chunk, own_block = F.pmod(F.xxhash64("vec_id", "v", "label"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    data = rows.join(plan, "cell").select("dim", "cell", own_chunk.alias("chunk"), all_of("blocks").alias("block"), "vec_id", "label", "v")
    ask = visits.withColumn("cell", F.explode("cells")).join(plan, "cell")
    ask = ask.select("dim", "cell", all_of("chunks").alias("chunk"), own_block.alias("block"), "query", "vec_id", "label", "v", "low", "high")
    tiles = data.unionByName(ask, allowMissingColumns=True).groupBy("dim", "cell", "chunk", "block")
    return best_by_query(tiles.applyInArrow(_in_tile(shared, k, same, leaf_rows), "query long, id long, score long, node long"), k), visits


def whole(x: Column) -> Column:
    """floor(256 * x) as a double, which beyond 2^53 is whole already."""
    y = x * SCALE
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def mined(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5), id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    is_anchor refers to vec_id, label to the columns of vectors; a negative's score is at least the fraction ``least`` of
    the positive's, and at most the positive's."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    names = {"vec_id": F.col(id_col).cast("long"), "label": label.cast("long"), "embedding": F.col(vector_col)}
    plain = vectors.select(*(c.alias(n) for n, c in names.items())).filter("label is not null")
    rows = usable(plain, "vec_id", "embedding", zero=True, more=("label",)).select("vec_id", "label", F.transform("v", whole).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dim, n = common_length(rows)
    most = rows.agg(F.max(norm).alias("most")).first()["most"]
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = [] if not n else sorted((r["vec_id"], r["label"], r["v"]) for r in rows.filter(F.size("v") == dim).filter(draw < min(1.0, sample_rows / n)).collect())
    ids, labels = np.array([r[0] for r in sample], np.int64), np.array([r[1] for r in sample], np.int64)
    v = np.array([r[2] for r in sample], float).reshape(len(sample), dim)
    shared = spark.sparkContext.broadcast(top_of(ids, labels, v, float(most or 0), min(MAX_CELLS, max(1, math.ceil(n / shard_rows))), dim))
    routed = written(rows.mapInArrow(_route(shared), "vec_id long, label long, v array<double>, dim int, cell int"), "cells")
    sizes = shard_rows, query_rows, leaf_rows

    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("v", "label"))
    anchors = written(routed.filter(is_anchor).select("vec_id", "label", "v", first.alias("n")).filter("n = 1").drop("n"), "anchors")
    ask = anchors.select(F.col("vec_id").alias("query"), "*", F.lit(LOWEST + 1).alias("low"), F.lit(2**63 - 1).alias("high"))
    found, asked = _searched(routed, ask, shared, positives, True, sizes)
    # a query of its own for each anchor and positive
    number = F.monotonically_increasing_id()
    low = F.expr(f"score div {least[1]} * {least[0]}") + F.ceil(F.expr(f"score % {least[1]}") * least[0] / least[1])
    pairs = written(found.select(F.col("query").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), number.alias("query"), low.cast("long").alias("low")).filter("low <= positive_score"), "positives")
    ask = pairs.join(anchors, F.col("anchor_id") == F.col("vec_id")).select("query", "vec_id", "label", "v", "low", F.col("positive_score").alias("high"))
    found, asked_again = _searched(routed, ask, shared, negatives, False, sizes)
    best = found.select("query", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = best.join(pairs, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    kept = written(out, "negatives")
    discard(routed, anchors, pairs, asked, asked_again)
    return kept


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


SQL = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok a JOIN ok c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
