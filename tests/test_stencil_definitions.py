"""Sharpening, ridges and edges of small rasters against loops that follow their definitions."""

import math

import numpy as np
import pytest

from gridloom.operators import stencil

H, W = 20, 20


@pytest.fixture(scope="module")
def raster(spark):
    rng = np.random.default_rng(12)
    a = np.round(rng.random((H, W)) * 60 + 80 * (np.add.outer(np.arange(H), np.arange(W)) % 11 < 3), 0)
    df = spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(H) for c in range(W)], "raster_id long, r int, c int, v double")
    return a, df, spark.createDataFrame([(1, W, H)], "raster_id long, width int, height int")


def mirrored(i, n):
    i = abs(i)
    return i if i < n else 2 * (n - 1) - i


def test_unsharp(raster):
    a, df, scenes = raster
    w = [math.exp(-(k * k) / 8) for k in range(-8, 9)]
    w = [x / sum(w) for x in w]
    soft = np.array([[sum(w[i + 8] * w[j + 8] * a[mirrored(r + i, H), mirrored(c + j, W)] for i in range(-8, 9) for j in range(-8, 9)) for c in range(W)] for r in range(H)])
    got = {(r["r"], r["c"]): r["v"] for r in stencil.unsharp(df, scenes).collect()}
    assert len(got) == H * W and all(abs(got[r, c] - (1.4 * a[r, c] - 0.4 * soft[r, c])) < 1e-9 for r in range(H) for c in range(W))


def sobel(a, r, c):
    gx = sum(w * (a[r + i, c + 1] - a[r + i, c - 1]) for i, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (a[r + 1, c + j] - a[r - 1, c + j]) for j, w in ((-1, 1), (0, 2), (1, 1)))
    angle = math.degrees(math.atan2(gy, gx))
    return gx, gy, angle + 180 if angle < 0 else angle


def sector(angle, first, second):
    """Steps to the two neighbours that a pixel is compared with, by the direction of its gradient."""
    if angle < 22.5 or angle >= 157.5:
        return (0, 1), (0, -1)
    if angle < 67.5:
        return first
    if angle < 112.5:
        return (1, 0), (-1, 0)
    return second


DOWN_LEFT, DOWN_RIGHT = ((1, -1), (-1, 1)), ((1, 1), (-1, -1))


def test_ridges(raster):
    a, df, _ = raster
    a = a / 255
    want = set()
    for r in range(1, H - 1):
        for c in range(1, W - 1):
            gx, gy, angle = sobel(a, r, c)
            ends = max(a[r + i, c + j] for i, j in sector(angle, DOWN_LEFT, DOWN_RIGHT))
            if a[r, c] >= 0.05 and (a[r, c] >= ends or a[r, c] >= 0.15 and math.hypot(gx, gy) < 0.05):
                want.add((r, c))
    got = {(x["r"], x["c"]) for x in stencil.ridges(df.selectExpr("raster_id", "r", "c", "v / 255 as v")).collect()}
    assert got == want and 20 < len(want) < 300


def test_edges(raster):
    a, df, _ = raster
    size, angle = np.zeros((H, W)), np.zeros((H, W))
    for r in range(1, H - 1):
        for c in range(1, W - 1):
            gx, gy, angle[r, c] = sobel(a, r, c)
            size[r, c] = abs(gx) + abs(gy)
    thin = set()
    for r in range(1, H - 1):
        for c in range(1, W - 1):
            if size[r, c] > 200 and all(size[r, c] >= size[r + i, c + j] for i, j in sector(angle[r, c], DOWN_RIGHT, DOWN_LEFT)):
                thin.add((r, c))
    want, todo = set(), [p for p in thin if size[p] > 380]
    while todo:
        p = todo.pop()
        if p not in want:
            want.add(p)
            todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (p[0] + i, p[1] + j) in thin]
    got = {(x["r"], x["c"]) for x in stencil.edges(df, 200.0, 380.0).collect()}
    assert got == want and 0 < len(want) < len(thin)
