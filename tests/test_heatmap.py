"""The chain from an image to its surface and roads."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import mask, skeleton
from gridloom.plans import heatmap


def image(spark):
    """Two scenes with a bright road on dark ground; in the second it is fainter beyond the middle."""
    rng = np.random.default_rng(4)
    rows = []
    for k in (1, 2):
        a = rng.integers(40, 60, (64, 80, 3)).astype(float)
        a[30:35] = 200
        a[:, 38:41] = 190
        rows += [(k, r, c, *a[r, c].tolist()) for r in range(64) for c in range(80)]
    bands = spark.createDataFrame(rows, "raster_id long, r int, c int, red double, green double, blue double")
    return bands, spark.createDataFrame([(1, 80, 64), (2, 80, 64)], "raster_id long, width int, height int")


def by_brightness(bands, scenes):
    """Bright is road; in the second scene the upper half is less sure."""
    p = F.when(F.col("red") > 120, F.when((F.col("raster_id") == 2) & (F.col("r") < 26), 0.3).otherwise(0.9)).otherwise(0.05)
    return bands.select("raster_id", "r", "c", p.alias("p"))


def test_exact_heatmap(spark):
    bands, scenes = image(spark)
    found = heatmap.exact_heatmap(bands, scenes, by_brightness, tile=32)
    heat = found["heat"].toPandas()
    assert len(heat) == 2 * 64 * 80 and heat["v"].between(0, 1).all()
    on = heat[(heat["r"].between(31, 33))]["v"].mean()
    off = heat[(heat["r"] > 45) & ~heat["c"].between(30, 48)]["v"].mean()
    assert on > 0.7 and off < 0.4
    main, secondary, overlay = (set(map(tuple, found[n].select("raster_id", "r", "c").collect())) for n in ("main", "secondary", "overlay"))
    assert not main & secondary
    # the unsure part of the second scene is in the secondary lines only
    assert any(k == 2 and r < 20 for k, r, _ in secondary) and not any(k == 2 and r < 20 for k, r, _ in main)
    assert any(k == 1 and r < 20 for k, r, _ in main)
    # lines are one pixel wide, the overlay is both dilated to the right and below
    want = {(k, r + i, c + j) for k, r, c in main | secondary for i in (0, 1) for j in (0, 1) if r + i < 64 and c + j < 80}
    assert overlay == want
    lines = skeleton.centerlines(by_brightness(heatmap.contrast(bands, scenes, 32), scenes), 0.5)
    assert abs(len(main) - lines.count()) <= 0.2 * len(main)


def test_contrast_spreads_the_lightness(spark):
    bands, scenes = image(spark)
    before, after = bands.toPandas(), heatmap.contrast(bands, scenes, 32).toPandas()
    assert len(after) == len(before) and after[["red", "green", "blue"]].stack().between(0, 255).all()
    dark = lambda d: d[(d["r"] > 45) & (d["c"] > 50)]["green"]
    assert dark(after).std() > 1.5 * dark(before).std()


def test_other_tiles_same_rows(spark):
    bands, scenes = image(spark)
    a, b = (sorted(map(tuple, heatmap.contrast(bands, scenes, t).collect())) for t in (32, 64))
    assert a == b
    assert mask.union(bands.limit(0), bands.limit(0)).count() == 0
