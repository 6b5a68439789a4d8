"""Each step of the degradation against its definition, and pairs that reruns and other partitions repeat."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import registry_images
from gridloom.plans import degrade

RNG = np.random.default_rng(3)


def test_weights():
    for mode in degrade.MODES:
        for n, m in ((5, 5), (7, 3), (4, 9), (1, 4), (10, 1)):
            w = degrade.weights(n, m, mode)
            assert w.shape == (m, n) and np.allclose(w.sum(1), 1)
            if n == m:
                assert np.allclose(w, np.eye(n))
    assert np.allclose(degrade.weights(2, 4, "bilinear") @ [0, 1], [0, 0.25, 0.75, 1])
    assert np.allclose(degrade.weights(6, 3, "area") @ [1, 3, 5, 7, 9, 11], [2, 6, 10])
    # bins of other lengths overlap
    assert np.allclose(degrade.weights(5, 2, "area") @ [0, 0, 6, 0, 3], [2, 3])
    # the cubic of a = -0.75 at place 3.75
    assert np.allclose(degrade.weights(8, 16, "bicubic")[8, 2:6], [-0.03515625, 0.26171875, 0.87890625, -0.10546875])
    ramp = degrade.weights(20, 10, "bicubic") @ np.arange(20.0)
    assert np.allclose(np.diff(ramp[1:-1]), 2)
    # a given step is used as it is
    assert np.allclose(degrade.weights(10, 7, "bilinear", 1.4) @ np.arange(10.0), [min(9, max(0, (i + 0.5) * 1.4 - 0.5)) for i in range(7)])


def test_filter_and_sharpening():
    image, kernel = RNG.random((9, 11, 3)), RNG.random((5, 5))
    got, wide = degrade.filtered(image, kernel), np.pad(image, ((2, 2), (2, 2), (0, 0)), mode="reflect")
    for r, c, k in ((0, 0, 0), (4, 5, 1), (8, 10, 2), (3, 0, 1)):
        assert math.isclose(got[r, c, k], sum(kernel[i, j] * wide[r + i, c + j, k] for i in range(5) for j in range(5)))

    assert np.allclose(degrade.sharpened(np.full((30, 30, 3), 0.4)), 0.4)
    image = RNG.random((12, 14, 3))
    got = degrade.sharpened(image, 0.5, 7, 10)
    sigma = 0.3 * (3 - 1) + 0.8
    line = np.exp(-((np.arange(7) - 3) ** 2) / (2 * sigma**2))
    gauss = np.outer(line, line) / line.sum() ** 2
    rest = image - degrade.filtered(image, gauss)
    soft = degrade.filtered((abs(rest) * 255 > 10).astype(float), gauss)
    assert np.allclose(got, soft * np.clip(image + 0.5 * rest, 0, 1) + (1 - soft) * image)


def _by_sums(block, table):
    """One 8 x 8 block through the transform as it is defined."""
    norm = [1 / math.sqrt(2)] + [1] * 7
    wave = [[math.cos((2 * i + 1) * u * math.pi / 16) for i in range(8)] for u in range(8)]
    f = [[norm[u] * norm[v] / 4 * sum(block[i][j] * wave[u][i] * wave[v][j] for i in range(8) for j in range(8)) for v in range(8)] for u in range(8)]
    f = [[round(f[u][v] / table[u][v]) * table[u][v] for v in range(8)] for u in range(8)]
    return [[sum(norm[u] * norm[v] / 4 * f[u][v] * wave[u][i] * wave[v][j] for u in range(8) for v in range(8)) for j in range(8)] for i in range(8)]


def test_jpeg():
    plane = RNG.normal(0, 40, (16, 24))
    for factor in (0.1, 1.0):
        got = degrade.quantised(plane, degrade.LUMA * factor)
        for a in (0, 8):
            for b in (0, 8, 16):
                assert np.allclose(got[a : a + 8, b : b + 8], _by_sums(plane[a : a + 8, b : b + 8].tolist(), (degrade.LUMA * factor).tolist()))
    for shape in ((16, 16, 3), (13, 21, 3), (1, 1, 3)):
        image = RNG.random(shape)
        assert degrade.jpeg(image, 50).shape == shape
    # gray keeps its gray; a better quality is nearer; at 100 only colour differences lose
    y, x = np.indices((32, 32))
    image = np.stack([0.5 + 0.3 * np.sin(x / 5), 0.5 + 0.3 * np.cos(y / 7), 0.5 + 0.2 * np.sin((x + y) / 6)], -1)
    errors = [np.abs(degrade.jpeg(image, q) - image).mean() for q in (10, 30, 60, 95)]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.02
    gray = np.repeat(image[..., :1], 3, -1)
    out = degrade.jpeg(gray, 40)
    assert np.allclose(out[..., 0], out[..., 1], atol=1e-4) and np.allclose(degrade.jpeg(gray, 100), gray, atol=1e-4)


def test_noise():
    flat = np.full((120, 120, 3), 0.5)
    for gray in (False, True):
        got = degrade.gaussian_noise(flat, 20, gray, np.random.default_rng(1)) - flat
        assert abs(got.std() * 255 - 20) < 0.6 and abs(got.mean()) < 0.002
        assert np.allclose(got[..., 0], got[..., 1]) == gray
        # one value: one level, so counts of mean 0.5 (128 of 255)
        got = degrade.poisson_noise(flat, 0.05, gray, np.random.default_rng(1)) - flat
        assert abs(got.std() - 0.05 * math.sqrt(128 / 255)) < 0.002
        assert np.allclose(got[..., 0], got[..., 1]) == gray
    # 256 values: the deviation falls with the root of the levels and grows with the value's
    ramp = np.repeat(np.repeat(np.arange(256.0)[None, :, None] / 255, 400, 0), 3, -1)
    got = degrade.poisson_noise(ramp, 1.0, False, np.random.default_rng(2)) - ramp
    assert abs(got[:, 64].std() / math.sqrt(64 / 255 / 256) - 1) < 0.1


def _images(spark, n, h, w):
    return spark.range(n).select(F.col("id").alias("raster_id"), F.lit(h).alias("height"), F.lit(w).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(h * w * 3 - 1)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(256)) / 255.0).alias("pixels"))


def test_pairs(spark):
    images = _images(spark, 6, 40, 32)
    got = {r["raster_id"]: r for r in degrade.training_pairs(images).collect()}
    again = {r["raster_id"]: r for r in degrade.training_pairs(images.repartition(3)).collect()}
    assert got == again and len(got) == 6
    for r in got.values():
        assert (r["height"], r["width"], r["lq_height"], r["lq_width"]) == (40, 32, 10, 8)
        assert len(r["gt"]) == len(r["gt_usm"]) == 40 * 32 * 3 and len(r["lq"]) == 240
        steps = np.array(r["lq"]) * 255
        assert np.allclose(steps, np.round(steps)) and 0 <= min(r["lq"]) and max(r["lq"]) <= 1
    assert len({tuple(r["lq"]) for r in got.values()}) == 6
    cut = degrade.training_pairs(images, gt_size=16).collect()
    whole = {i: np.array(r["gt"]).reshape(40, 32, 3) for i, r in got.items()}
    for r in cut:
        gt, found = np.array(r["gt"]).reshape(16, 16, 3), whole[r["raster_id"]]
        assert any(np.array_equal(gt, found[a : a + 16, b : b + 16]) for a in range(0, 25, 4) for b in range(0, 17, 4))
        assert len(r["lq"]) == 48
    assert degrade.training_pairs(images.limit(0)).count() == 0
    assert degrade.training_pairs(images.withColumn("pixels", F.when(F.col("raster_id") > 1, F.col("pixels")))).count() == 4
    with pytest.raises(Exception, match="smaller than"):
        degrade.training_pairs(images, gt_size=36).count()
    with pytest.raises(Exception, match="are not"):
        degrade.training_pairs(images.withColumn("width", F.lit(31))).count()


def test_query(spark, sf):
    rows = registry_images.QUERIES["degraded_images"](spark, sf).collect()
    assert sum(r["lq_height"] for r in rows) > 0 and all(len(r["lq"]) == r["lq_height"] * r["lq_width"] * 3 for r in rows)
