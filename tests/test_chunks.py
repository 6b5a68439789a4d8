"""Operators on tables of tiles give the rows of those on pixels, and move only edge strips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import chunks, components, distance, mask, stencil

SIZES = {1: (37, 50), 2: (20, 9), 3: (16, 16)}
TILE = 16
KEYS = ["raster_id", "r", "c"]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    dense = [(k, r, c, float(np.round(rng.random() + math.sin(r / 5) * math.cos(c / 6), 3))) for k, (h, w) in SIZES.items() for r in range(h) for c in range(w)]
    pixels = spark.createDataFrame(dense, "raster_id long, r int, c int, v double").cache()
    scenes = spark.createDataFrame([(k, w, h) for k, (h, w) in SIZES.items()], "raster_id long, width int, height int")
    return pixels, pixels.filter("v > 0.8").select(*KEYS).cache(), scenes


def rows(df, *names):
    return sorted(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in df.select(*KEYS, *names).collect())


def of_mask(world):
    return chunks.from_pixels(world[1], world[2], tile=TILE)


def of_values(world):
    return chunks.from_pixels(world[0], world[2], "v", TILE)


def test_round_trip(world):
    assert rows(chunks.to_pixels(of_mask(world), ())) == rows(world[1])
    assert rows(chunks.to_pixels(of_values(world)), "v") == rows(world[0], "v")
    gaps = chunks.from_pixels(world[1].withColumn("v", F.lit(2.0)), world[2], "v", TILE)
    assert rows(chunks.to_pixels(gaps), "v") == rows(world[1].withColumn("v", F.lit(2.0)), "v")


MORPHOLOGY = {
    "dilate": (lambda m, s: mask.dilate(m, s, 3), lambda m: chunks.dilate(m, 3)),
    "erode": (lambda m, s: mask.erode(m, s, 2), lambda m: chunks.erode(m, 2)),
    "close_open": (lambda m, s: mask.close_open(m, s, 2, 1), lambda m: chunks.close_open(m, 2, 1)),
    "line of 4": (lambda m, s: mask.dilate_line(m, s, 4), lambda m: chunks.dilate_line(m, 4)),
    "line of 5": (lambda m, s: mask.dilate_line(m, s, 5), lambda m: chunks.dilate_line(m, 5)),
    "down and right": (lambda m, s: mask.dilate_down_right(m, s), lambda m: chunks.dilate_line(m, 2)),
    "plus grows": (lambda m, s: mask.dilate_plus(m, s), lambda m: chunks.plus(m, True)),
    "plus shrinks": (lambda m, s: mask.erode_plus(m, s), lambda m: chunks.plus(m, False)),
}


@pytest.mark.parametrize("name", set(MORPHOLOGY) - {"down and right"})
def test_morphology(world, name):
    plain, tiled = MORPHOLOGY[name]
    assert rows(chunks.to_pixels(tiled(of_mask(world)), ())) == rows(plain(world[1], world[2]))


def test_tiles_without_a_pixel_get_one(spark, world):
    """A pixel in a corner grows into three tiles that have no row."""
    one = spark.createDataFrame([(1, 15, 15)], "raster_id long, r int, c int")
    tiled = chunks.from_pixels(one, world[2], tile=TILE)
    grown = chunks.dilate(tiled, 1)
    assert tiled.table.count() == 1 and grown.table.count() == 4
    assert rows(chunks.to_pixels(grown, ())) == rows(mask.dilate(one, world[2], 1))


def test_neighbours_and_values(world):
    pixels, m, scenes = world
    counts = chunks.to_pixels(chunks.neighbour_count(of_mask(world)), ("n",))
    assert rows(counts.withColumn("n", F.col("n").cast("long")), "n") == rows(stencil.neighbour_count(m), "n")
    v = of_values(world)
    assert rows(chunks.to_pixels(chunks.gaussian(v, 1.3)), "v") == rows(stencil.gaussian(pixels, scenes, 1.3), "v")
    assert rows(chunks.to_pixels(chunks.gaussian(v, 1.3, mirror_edge=True)), "v") == rows(stencil.gaussian(pixels, scenes, 1.3, mirror_edge=True), "v")
    bands = ("gx", "gy", "magnitude", "direction")
    assert rows(chunks.to_pixels(chunks.gradient(v), bands), *bands) == rows(stencil.gradient(pixels), *bands)
    assert rows(chunks.to_pixels(chunks.median(v, 2)), "v") == rows(stencil.median(pixels, scenes, 2, 16), "v")


def test_ridges_of_bright_and_dark(world):
    pixels, _, scenes = world
    sigmas = (1.2, 2.0)
    both = stencil.frangi(pixels, scenes, sigmas).unionByName(stencil.frangi(pixels, scenes, sigmas, bright=False)).groupBy(*KEYS).agg(F.max("v").alias("v"))
    assert rows(chunks.to_pixels(chunks.frangi(of_values(world), sigmas, dark=True)), "v") == rows(both, "v")


@pytest.mark.parametrize("eight", [True, False])
def test_components(world, eight):
    got = chunks.to_pixels(chunks.components(of_mask(world), eight), ("label",)).withColumn("label", F.col("label") - 1)
    assert rows(got, "label") == rows(components.label(world[1], eight, 16), "label")


def test_components_across_every_kind_of_seam(spark, world):
    """Pixels that touch at the corner of four tiles in both directions, beside a seam, and a ring around tiles."""
    cells = [(15, 16), (16, 15), (5, 15), (4, 16), (20, 31), (21, 32), (31, 20), (32, 19)] + [(r, c) for r in range(2, 35) for c in range(2, 35) if r in (2, 34) or c in (2, 34)]
    m = spark.createDataFrame([(1, r, c) for r, c in cells], "raster_id long, r int, c int")
    got = chunks.to_pixels(chunks.components(chunks.from_pixels(m, world[2], tile=TILE)), ("label",)).withColumn("label", F.col("label") - 1)
    assert rows(got, "label") == rows(components.label(m, True, 512), "label")


def test_distance(spark, world):
    got = chunks.to_pixels(chunks.distance(of_mask(world)), ("dist",)).filter("dist > 0")
    assert rows(got, "dist") == rows(distance.distance(world[1], world[2]), "dist")
    # roads that run through tiles from border to border, and a raster that is all foreground
    stripes = world[0].filter("raster_id = 3 or c % 11 < 7 and raster_id = 1 or r > 16 and raster_id = 2").select(*KEYS)
    got = chunks.to_pixels(chunks.distance(chunks.from_pixels(stripes, world[2], tile=TILE)), ("dist",))
    want = {r[:3]: r[3] for r in distance.distance(stripes, world[2]).select(*KEYS, "dist").collect()}
    found = {r[:3]: r[3] for r in got.filter("dist > 0").select(*KEYS, "dist").collect()}
    assert found.keys() == want.keys()
    assert all(math.isinf(found[k]) if v is None else abs(found[k] - v) < 1e-9 for k, v in want.items())


def test_only_strips_are_shuffled(world):
    """The tiles come from buckets: the exchange in the plan of a step carries strips and no tile."""
    v = of_values(world)
    joined = v.table.join(chunks._strips(v, 2), chunks.PLACE, "full_outer")
    exchanges = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1
    # and they hold the rows next to the seams only
    sent = chunks._strips(v, 2).select(F.explode("strips").alias("s")).select(F.octet_length("s.strip").alias("n")).agg(F.sum("n")).first()[0]
    h, w = SIZES[1]
    seams = 8 * 2 * (2 * 2 * w + 3 * 2 * h) + 8 * 2 * 2 * 9 + 8 * 4 * (2 * 3 * 4)
    assert sent <= seams


def test_halo_must_fit(world):
    with pytest.raises(ValueError, match="halo"):
        chunks.dilate(of_mask(world), TILE + 1)


def test_empty(spark, world):
    none = chunks.from_pixels(world[1].limit(0), world[2], tile=TILE)
    assert chunks.to_pixels(chunks.close_open(none), ()).count() == 0
    assert chunks.to_pixels(chunks.components(none), ("label",)).count() == 0 and chunks.to_pixels(chunks.distance(none), ("dist",)).count() == 0


def equalised(a, clip, grid):
    """The definition, pixel by pixel."""
    h, w = a.shape
    cell = lambda i, n: min(int(i / (n / grid)), grid - 1)
    luts = {}
    for gy in range(grid):
        for gx in range(grid):
            own = [int(a[r, c]) for r in range(h) for c in range(w) if cell(r, h) == gy and cell(c, w) == gx]
            n = np.bincount(own, minlength=256).astype(float)
            limit = max(math.floor(clip * len(own) / 256), 1)
            over = np.maximum(n - limit, 0).sum()
            luts[gy, gx] = np.cumsum(np.minimum(n, limit) + over / 256) * 255 / len(own)
    out = np.zeros(a.shape)
    for r in range(h):
        for c in range(w):
            fy, fx = (r + 0.5) / (h / grid) - 0.5, (c + 0.5) / (w / grid) - 0.5
            y, x = math.floor(fy), math.floor(fx)
            hold = lambda k: min(max(k, 0), grid - 1)
            v = sum(luts[hold(y + i), hold(x + j)][int(a[r, c])] * (fy - y if i else 1 - fy + y) * (fx - x if j else 1 - fx + x) for i in (0, 1) for j in (0, 1))
            out[r, c] = math.floor(v + 0.5)
    return out


def test_equalisation(spark, world):
    pixels = world[0].withColumn("v", F.floor(F.pmod(F.col("v") * 90, F.lit(256.0))).cast("double"))
    for grid, clip in ((4, 2.0), (3, 3.5)):
        tiled = {r[:3]: r[3] for r in rows(chunks.to_pixels(chunks.clahe(chunks.from_pixels(pixels, world[2], "v", TILE), clip, grid)), "v")}
        plain = {r[:3]: r[3] for r in rows(stencil.clahe(pixels, world[2], clip, grid), "v")}
        values = {r[:3]: r[3] for r in rows(pixels, "v")}
        for k, (h, w) in SIZES.items():
            want = equalised(np.array([[values[k, r, c] for c in range(w)] for r in range(h)]), clip, grid)
            for r in range(h):
                for c in range(w):
                    assert abs(tiled[k, r, c] - want[r, c]) <= 1 and abs(plain[k, r, c] - want[r, c]) <= 1
            assert sum(tiled[k, r, c] != want[r, c] for r in range(h) for c in range(w)) <= 0.01 * h * w
