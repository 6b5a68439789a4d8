"""Operator 2: approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one code word from each of ``STAGES`` codebooks, all of the
full dimension. Codebooks are trained stage by stage on the residuals of a bounded sample (about
``SAMPLE_ROWS`` rows, chosen by a hash of the id) and then fitted together by least squares. Every
row is indexed: beam search keeps the ``BEAM`` best partial sums from stage to stage, and the ratio
of the norms of vector and approximation is stored beside the codes. A query's inner products with
all code words are one small table; the score of a row is the sum of its codes' entries times the
stored ratio. In every tile of a query block and a shard the ``RERANK`` best rows by that score are
scored again exactly, in double precision on the original vectors, and the exact lists are merged in a tree.

The exact work is ``RERANK`` rows of every ``SHARD_ROWS`` for each query, so it grows with the table
as the table scores do, at a fixed share of them.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without an id take no part; vectors are compared with those of their own length, those of another
length than the most common one exactly, as they have no code words; rows that repeat an id are
candidates each for themselves, but never for a query of their id, and of queries that repeat an id
the one with the smallest vector asks; ties go to the smaller id; an empty table, or one row, gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, table
from gridloom.llm.vectors import AT_ONCE, QUERY_ROWS, SHARD_ROWS, best, by_tile, common_length, first_of_each, matrix, merged, sorted_rows, tiles, usable

STAGES, WORDS, BEAM = 16, 256, 4
SAMPLE_ROWS = 16_384
#: Rows of a tile that are scored exactly for each query.
RERANK = 128


@dataclass
class Codebooks:
    words: np.ndarray  # (stages, words, dim), float32


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    words = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        near = (rows @ words.T - 0.5 * (words * words).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        for d in range(rows.shape[1]):
            words[:, d] = np.where(n > 0, np.bincount(near, weights=rows[:, d], minlength=k) / np.maximum(n, 1), words[:, d])
    return words, (rows @ words.T - 0.5 * (words * words).sum(1)).argmax(1)


def train(sample: np.ndarray, stages: int = STAGES, n_words: int = WORDS, seed: int = 2) -> Codebooks:
    rng = np.random.default_rng(seed)
    rows, words = sample.astype(np.float32), []
    rest = rows.copy()
    k = min(n_words, max(1, len(rows)))
    for _ in range(stages):
        found, near = _k_means(rest, k, rng)
        words.append(found)
        rest = rest - found[near]
    books = Codebooks(np.stack(words))
    return _fitted(books, rows)


def _fitted(books: Codebooks, rows: np.ndarray) -> Codebooks:
    """Least squares over all code words at once, for the codes that beam search gives (conjugate gradients)."""
    m, k, d = books.words.shape
    codes = encode(books, rows) + np.arange(m) * k

    def normal(x: np.ndarray) -> np.ndarray:
        sums = sum(x[codes[:, j]] for j in range(m))
        return back(sums) + 1e-3 * x

    def back(y: np.ndarray) -> np.ndarray:
        out = np.zeros((m * k, d))
        for j in range(m):
            order = np.argsort(codes[:, j], kind="stable")
            c = codes[order, j]
            first = np.flatnonzero(np.r_[True, np.diff(c) != 0])
            out[c[first]] += np.add.reduceat(y[order], first, axis=0)
        return out

    x = books.words.reshape(m * k, d).astype(float)
    r = back(rows.astype(float)) - normal(x)
    p, rr = r.copy(), (r * r).sum()
    for _ in range(10):
        ap = normal(p)
        a = rr / max((p * ap).sum(), 1e-30)
        x, r = x + a * p, r - a * ap
        new = (r * r).sum()
        p, rr = r + (new / max(rr, 1e-30)) * p, new
    return Codebooks(x.reshape(m, k, d).astype(np.float32))


def encode(books: Codebooks, rows: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, stages) by beam search over the partial sums."""
    return np.concatenate([_beam(books.words, rows[i : i + 512].astype(np.float32), beam) for i in range(0, len(rows), 512)]) if len(rows) else np.zeros((0, len(books.words)), np.int64)


def _beam(words: np.ndarray, rows: np.ndarray, beam: int) -> np.ndarray:
    m, k, d = words.shape
    n = len(rows)
    rest = rows[:, None, :]
    codes = np.zeros((n, 1, 0), dtype=np.int64)
    for j in range(m):
        # squared error of each partial sum with each word, less what does not depend on the word
        own = (rest * rest).sum(2)
        cost = (own[:, :, None] + (words[j] ** 2).sum(1) - 2 * (rest.reshape(-1, d) @ words[j].T).reshape(n, -1, k)).reshape(n, -1)
        b = 1 if j == m - 1 else min(beam, cost.shape[1])
        at = cost.argmin(1)[:, None] if b == 1 else np.argpartition(cost, b - 1, axis=1)[:, :b]
        parent, word = at // k, at % k
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[j][word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], 2)
    return codes[:, 0]


def _index(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            rows = matrix(batch.column(1), dim)
            codes = encode(books, rows)
            near = sum(books.words[j][codes[:, j]] for j in range(len(books.words))).astype(float)
            ratio = np.sqrt((rows * rows).sum(1)) / np.maximum(np.sqrt((near * near).sum(1)), 1e-12)
            packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(ratio)], ["vec_id", "v", "codes", "ratio"])

    return run


def _search(shared, k: int, rerank: int):
    def run(ask, data):
        words = shared.value.words
        m = len(words)
        q_ids, q = first_of_each(*sorted_rows(ask))
        ids, v, packed, ratio = sorted_rows(data, "codes", "ratio")
        coded = v.shape[1] == words.shape[2]
        if coded:
            codes, ratio = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, m), ratio.astype(np.float32)
        out_q, out_v, out_s = [], [], []
        own, end = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
        for at in range(0, len(q_ids), AT_ONCE):
            if coded:
                some = q[at : at + AT_ONCE].astype(np.float32)
                near = np.zeros((len(ids), len(some)), np.float32)
                for j in range(m):
                    near += (words[j] @ some.T)[codes[:, j]]  # the lookup table of stage j, a row for each word
                near *= ratio[:, None]
                near = np.ascontiguousarray(near.T)
            for i in range(at, min(at + AT_ONCE, len(q_ids))):
                found = best(near[i - at], rerank + end[i] - own[i]) if coded else np.arange(len(ids))
                found = found[ids[found] != q_ids[i]]
                # exactly, in double precision
                score = (v[found] * q[i]).sum(1)
                found_ids = ids[found]
                first = np.lexsort((found_ids, -score))[:k]
                out_q.append(np.full(len(first), q_ids[i]))
                out_v.append(found_ids[first])
                out_s.append(score[first])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, rerank: int = RERANK,
    query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found by inner product; is_query refers to vec_id."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = usable(vectors, id_col, vector_col, zero=False)
    dim, n = common_length(rows)
    n_all, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    if not n_queries:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    common = rows.filter(F.size("v") == dim)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = sorted((r["vec_id"], r["v"]) for r in common.filter(draw < min(1.0, sample_rows / n)).collect())
    sample = sample or sorted((r["vec_id"], r["v"]) for r in common.limit(WORDS).collect())
    shared = spark.sparkContext.broadcast(train(np.array([v for _, v in sample])))
    index = common.mapInArrow(_index(shared, dim), "vec_id long, v array<double>, codes binary, ratio double")
    index = index.unionByName(rows.filter(F.size("v") != dim), allowMissingColumns=True)
    tiled, shards = tiles(index, rows.filter(is_query), n_all, n_queries, query_rows, shard_rows)
    return merged(by_tile(tiled, _search(shared, k, rerank), "double"), k, shards)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
