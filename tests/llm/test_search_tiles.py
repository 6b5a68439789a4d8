"""Operators 2 and 9 over many query blocks and shards, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import additive_quantisation, exact_topk
from gridloom.llm.vectors import merged


def table(spark, n=1500, dim=16, seed=29):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).round(2)
    v[100:140] = v[7]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(50, [9.0] * dim), (51, [9.0] * dim), (51, [9.0] * dim)]  # repeated ids
    rows += [(2000, [1.0, 2.0]), (2010, [3.0, 4.0]), (2020, [1.0, 1.0])]  # another length
    odd = [(3000, None), (3001, []), (3002, [None] * dim), (3003, [math.nan] * dim), (3004, [math.inf] * dim), (None, [1.0] * dim), (3010, [0.0] * dim)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, score string")


def brute(rows, asks, k, score, zero):
    out = {}
    first = {}
    for i, v in sorted(rows):
        first.setdefault(i, v)
    rows = rows + ([(3010, [0.0] * 16)] if zero else [])
    for q, v in first.items():
        if q % asks == 0:
            found = sorted((-score(v, w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("query_rows,shard_rows", [(7, 20), (64, 400), (2048, 8192)])
def test_exact(spark, query_rows, shard_rows):
    rows, df = table(spark)

    def score(a, b):
        return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))

    want = brute(rows, 10, 5, score, True) | {3010: None}
    got = by_query(exact_topk.top_k(df, F.col("vec_id") % 10 == 0, 5, query_rows=query_rows, shard_rows=shard_rows))
    assert set(got) == set(want)
    assert [x for q, x in got.items() if q != 3010 and x != want[q]] == []
    assert [s for _, s in got[3010]] == [0] * 5 and [i for i, _ in got[3010]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("query_rows,shard_rows", [(40, 300), (2048, 8192)])
def test_nearest(spark, query_rows, shard_rows):
    rows, df = table(spark)
    want = brute(rows, 10, 20, lambda a, b: float(np.dot(a, b)), False)
    got = by_query(additive_quantisation.nearest(df, F.col("vec_id") % 10 == 0, 20, rerank=64, query_rows=query_rows, shard_rows=shard_rows))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    right = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len({i for i, _ in want[q]})) for q in want])
    assert right >= 0.9
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(v)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(any(math.isclose(s, float(np.dot(sorted(vectors[q])[0], v)), abs_tol=1e-9) for v in vectors[i]) for i, s in found)
    assert {q for q in got if q >= 2000} == {2000, 2010, 2020} and [i for i, _ in got[2000]] == [2010, 2020]


def test_tree_of_lists(spark):
    rng = np.random.default_rng(1)
    rows = [(q, v, int(rng.integers(0, 20)), int(rng.integers(0, 5000))) for q in range(3) for v in range(2000)]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, score long, shard int")
    got = by_query(merged(df, 7, 5000))
    assert got == {q: sorted(((v, s) for a, v, s, _ in rows if a == q), key=lambda x: (-x[1], x[0]))[:7] for q in range(3)}


def test_overflow_is_an_error():
    big = np.full((1, 4), 2.0**40)
    with pytest.raises(OverflowError):
        exact_topk.products(big, big)
    assert exact_topk.products(big, np.full((1, 4), 2.0**15)).tolist() == [[2**57]]


def test_empty_tables(spark):
    _, df = table(spark)
    for some in (df.limit(0), df.filter("vec_id = 10"), df.filter("vec_id >= 3000")):
        assert additive_quantisation.nearest(some, F.col("vec_id") % 10 == 0, 5).collect() == []
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).collect() == []
