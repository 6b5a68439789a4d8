"""Hard negatives against brute force, and that the tree leaves out what it may."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import hard_negatives as hn


def brute(rows, anchors, positives=5, negatives=5):
    """rows: id, label, vector; the definition, in whole numbers."""
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {i for i, _, _ in ok if anchors(i)}:
        _, label, v = min((r for r in ok if r[0] == a), key=lambda r: (r[2], r[1]))
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in ok if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"v": F.lit(1), "cell": F.lit("x"), "query": F.lit(0), "score": F.lit(2)})
    got = hn.mined(df, anchors, F.col("label"), **sizes).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


def random_rows(n, d, labels, seed):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), [round(float(x), 2) for x in rng.normal(size=d)]) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "query_rows": 3, "leaf_rows": 4, "sample_rows": 60}])
def test_same_as_brute_force(spark, sizes):
    rows = random_rows(400, 4, 3, 1)
    rows += [(400 + i, i % 2, [0.5, 0.25, 0.125, 1.0]) for i in range(150)]  # copies: ties by id
    rows += [(7, 1, [1.0, 1.0, 1.0, 1.0]), (7, 0, [1.0, 1.0, 1.0, 1.0]), (20, 2, [-3.0, 0.0, 0.0, 0.0])]  # ids that repeat
    rows += [(600, 1, None), (601, 1, []), (602, 1, [1.0, None, 1.0, 1.0]), (603, 1, [math.nan, 1.0, 1.0, 1.0]), (604, None, [9.0] * 4), (None, 1, [9.0] * 4), (605, 0, [math.inf] * 4)]
    rows += [(i, i % 2, [float(i - 620), 2.0]) for i in range(610, 640)]  # another length
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and mined(spark, rows, F.col("vec_id") % 10 == 0, **sizes) == want


def test_few_rows_and_none(spark):
    anchors = F.col("vec_id") % 10 == 0
    assert mined(spark, [], anchors) == []
    assert mined(spark, [(0, 1, [1.0])], anchors) == [] and mined(spark, [(1, 1, [1.0])], anchors) == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.9, 0.0]), (3, 2, [0.0, 1.0]), (4, 1, [0.0, 0.5])]
    assert mined(spark, rows, anchors) == brute(rows, lambda i: i % 10 == 0)


def test_far_leaves_are_not_scored():
    """In few dimensions most leaves lie outside the ball or the annulus."""
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(8192, 2)))
    v *= 256 / np.sqrt((v * v).sum(1))[:, None]
    v = np.floor(v)
    ids, labels = np.arange(8192), rng.integers(0, 4, 8192)
    most = float((v * v).sum(1).max())
    every = np.full(50, hn.LOWEST + 1), np.full(50, 2**63 - 1)
    q = hn.Queries(ids[:50], labels[:50], v[:50], *every, True)
    score, found, formed = hn.search(q, ids, labels, v, most, 5)
    assert formed < 0.2 * 50 * 8192
    annulus = hn.Queries(ids[:50], labels[:50], v[:50], (0.79 * score[:, 4]).astype(np.int64), (0.8 * score[:, 4]).astype(np.int64), False)
    got, at, formed = hn.search(annulus, ids, labels, v, most, 5)
    assert formed < 0.2 * 50 * 8192
    for i in range(50):
        s = (v @ v[i]).astype(np.int64)
        fit = np.flatnonzero((labels != labels[i]) & (s >= annulus.low[i]) & (s <= annulus.high[i]))
        want = sorted(fit, key=lambda j: (-s[j], j))[:5]
        assert at[i][: len(want)].tolist() == want and (got[i][len(want) :] == hn.LOWEST).all()


def test_cells_of_the_upper_tree():
    """Every row that is among the best lies in a cell that its query visits."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 3))
    v = np.floor(256 * v / np.sqrt((v * v).sum(1))[:, None])
    ids, labels, most = np.arange(3000), rng.integers(0, 2, 3000), float((v * v).sum(1).max())
    top = hn.top_of(ids[:400], labels[:400], v[:400], most, 16, 3)
    cell = top.tree.route(hn.augmented(v, most))
    q = hn.Queries(ids[:100], labels[:100], v[:100], np.full(100, hn.LOWEST + 1), np.full(100, 2**63 - 1), True)
    reach = hn.reachable(top, q, 5)
    scored = q.qualified(ids, labels, v)
    best = np.argsort(-scored.astype(float), axis=1, kind="stable")[:, :5]
    assert reach[np.arange(100)[:, None], cell[best]].all() and reach.mean() < 0.6


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    got, want = hn.query(spark, sf).toPandas(), con.execute(hn.SQL).fetchdf()
    keys = ["anchor_id", "positive_id", "rank"]
    assert (got.sort_values(keys)[want.columns].to_numpy() == want.sort_values(keys).to_numpy()).all() and len(got) == len(want) > 0
