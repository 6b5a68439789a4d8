"""Operators at places far down a raster and on many rows, without a raster of that size."""

import pytest

from gridloom.operators import mask, tiling
from gridloom.plans import extract

SCENE, PIXELS = "raster_id long, width int, height int", "raster_id long, r int, c int, v double"


def test_resize_beyond_the_range_of_int(spark):
    h, n = 100_000, 75_000
    rows = [(0, r, c) for r in (0, 1, 53_511, h - 3, h - 2, h - 1) for c in (0, 63)]
    got = [tuple(x) for x in mask.resize_nearest(spark.createDataFrame(rows, "raster_id long, r int, c int"), h, 64, n, 100).collect()]
    kept = {r for _, r, _ in rows}
    want = {(0, i, j) for i in range(n) if i * h // n in kept for j in range(100) if j * 64 // 100 in (0, 63)}
    assert len(got) == len(want) and set(got) == want


def tall(spark):
    """A few pixels of a scene of so many rows that no array holds a place for each, and where its tiles of 4 rows begin."""
    n = 2**31 - 1
    at = (0, 1, 2_000_000_000, n - 1)
    rows = spark.createDataFrame([(0, r, 1, float(r % 7)) for r in at], PIXELS)
    return rows, spark.createDataFrame([(0, 3, n)], SCENE), {r: range(max(0, r - 3), min(r, n - 4) + 1) for r in at}


def test_tiles_of_a_pixel_do_not_depend_on_the_height(spark):
    rows, scene, starts = tall(spark)
    got = sorted((x["r"], x["row_off"], x["tile_id"], x["col_off"]) for x in extract.tiled(rows, scene, 4, 3).collect())
    assert got == sorted((r, k, k, 0) for r, own in starts.items() for k in own)
    p = {x["r"]: x["p"] for x in extract.probability(rows, scene, 4, 3).collect()}
    assert set(p) == set(starts) and p[0] == 0.0 and 0 < p[1] < 1


def test_uniform_blend_of_a_tall_scene(spark):
    rows, scene, _ = tall(spark)
    p = {x["r"]: x["p"] for x in extract.probability(rows, scene, 4, 3, uniform=True).collect()}
    assert p == {0: 0.0, 1: 0.5, 2_000_000_000: 0.0, 2**31 - 2: 0.0}


@pytest.mark.parametrize("tile, overlap", [(32, 8), (32, 0), (5, 4), (7, 2)])
def test_tiles_of_pixels_are_those_of_the_plan(spark, tile, overlap):
    sizes = [(1, 1), (3, 40), (31, 33), (32, 56), (57, 64), (80, 20)]
    scene = spark.createDataFrame([(k, w, h) for k, (w, h) in enumerate(sizes)], SCENE)
    rows = spark.createDataFrame([(k, r, c, 0.0) for k, (w, h) in enumerate(sizes) for r in range(h) for c in range(w)], PIXELS)
    plan = tiling.tile_pixels(tiling.windows(scene, tile, overlap))
    keys = ["raster_id", "tile_id", "r", "c", "row_off", "col_off"]
    got, want = ([tuple(x) for x in df.select(*keys).collect()] for df in (extract.tiled(rows, scene, tile, overlap), plan))
    assert len(got) == len(want) and set(got) == set(want)
