"""Queries with the settings of the reference, against loops and numpy."""

import numpy as np
import pytest

from gridloom import registry
from gridloom.sources import virtual


def starts(n, tile, stride):
    return list(range(0, max(n - tile, 0) + 1, stride))


def test_patches_every_32_pixels(spark, sf):
    want = {(s["raster_id"], x, y, f) for s in virtual.scene_catalog(spark, sf).collect() for y in starts(s["height"], 128, 32) for x in starts(s["width"], 128, 32) for f in (False, True)}
    got = [tuple(r) for r in registry.queries()["training_patches"](spark, sf).select("raster_id", "col_off", "row_off", "flipped").collect()]
    assert len(got) == len(want) and set(got) == want


def test_tiles_every_64_pixels_and_a_tail(spark, sf):
    def tail(n):
        return sorted({*starts(n, 256, 64), max(n - 256, 0)})

    want = {(s["raster_id"], x, y) for s in virtual.scene_catalog(spark, sf).collect() for y in tail(s["height"]) for x in tail(s["width"])}
    got = [tuple(r) for r in registry.queries()["tile_windows_tail"](spark, sf).select("raster_id", "col_off", "row_off").collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def unit(spark, sf):
    rows = registry._unit(spark, sf).toPandas()
    a = np.full((rows["r"].max() + 1, rows["c"].max() + 1), np.nan)
    a[rows["r"], rows["c"]] = rows["v"]
    return a


def found(df):
    return {(r["r"], r["c"]): r["v"] for r in df.collect()}


def test_median_of_seven_by_seven(spark, sf, unit):
    h, w = unit.shape
    pad = np.pad(unit, 3, mode="edge")
    want = np.median([pad[i : i + h, j : j + w] for i in range(7) for j in range(7)], axis=0)
    got = found(registry.queries()["median_filter"](spark, sf))
    assert len(got) == h * w and all(abs(v - want[k]) < 2e-6 for k, v in got.items())


def ridge(a, sigma, bright):
    n = int(4 * sigma + 0.5)
    k = np.exp(-np.arange(-n, n + 1) ** 2 / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        pad = np.pad(a, [(n, n) if x == axis else (0, 0) for x in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda x: np.convolve(x, k, mode="valid"), axis, pad)
    rr = a[2:, 1:-1] - 2 * a[1:-1, 1:-1] + a[:-2, 1:-1]
    cc = a[1:-1, 2:] - 2 * a[1:-1, 1:-1] + a[1:-1, :-2]
    rc = (a[2:, 2:] - a[2:, :-2] - a[:-2, 2:] + a[:-2, :-2]) / 4
    e = np.linalg.eigvalsh(sigma**2 * np.stack([np.stack([rr, rc], -1), np.stack([rc, cc], -1)], -1))
    e = np.take_along_axis(e, np.abs(e).argsort(-1), -1)
    l1, l2 = e[..., 0], e[..., 1]
    s = np.hypot(l1, l2)
    v = np.exp(-((l1 / l2) ** 2) / 0.5) * (1 - np.exp(-(s**2) / (2 * (s.max() / 2) ** 2)))
    return np.where(l2 < 0 if bright else l2 > 0, v, 0)


def test_bright_and_dark_ridges_of_four_scales(spark, sf, unit):
    want = np.max([ridge(unit, s, b) for s in (1.2, 2.0, 3.2, 4.8) for b in (True, False)], axis=0)
    got = found(registry.queries()["frangi_ridge"](spark, sf))
    assert len(got) == want.size and all(abs(v - want[r - 1, c - 1]) < 1e-5 for (r, c), v in got.items())
