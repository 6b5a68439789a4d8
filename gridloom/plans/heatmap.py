"""From an image to a probability surface and its roads: contrast, prediction, ridges, fusion, centre lines.

The stages meet on pixels where a rule is a column expression and on tables of tiles where it looks
around. Everything that several stages read is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.operators import chunks, mask, skeleton, stretch
from gridloom.plans import evidence
from gridloom.session import written

KEYS = ["raster_id", "r", "c"]
BANDS = ("red", "green", "blue")
#: Two equalisations (limit, cells a side, weight), and what sharpens their sum.
FINE, BROAD, SIGMA, AMOUNT = (3.5, 8, 0.65), (2.0, 24, 0.35), 2.0, 1.4
#: Scales of ridges, weights of prediction and ridges, smoothing and top percentiles of the surface.
SCALES, W_PREDICTION, W_RIDGES, SMOOTH, RIDGE_TOP, TOP = (1.2, 2.0, 3.2, 4.8), 0.65, 0.35, 0.6, 0.99, 0.992
#: A predictor takes bands (0..255) and scenes and gives p of every pixel.
Predict = Callable[[DataFrame, DataFrame], DataFrame]


def contrast(bands: DataFrame, scenes: DataFrame, tile: int = chunks.TILE) -> DataFrame:
    """Bands whose lightness is equalised on a fine and a broad grid, blended, and sharpened."""
    light, a, b = color.lab8(*(F.col(x) for x in BANDS))
    lab = written(bands.select(*KEYS, light.alias("v"), a.alias("_a"), b.alias("_b")), "lab")
    tiles = chunks.from_pixels(lab, scenes, "v", tile)
    fine, broad = (chunks.to_pixels(chunks.clahe(tiles, limit, grid)) for limit, grid, _ in (FINE, BROAD))
    blend = fine.join(broad.withColumnRenamed("v", "_w"), KEYS).select(*KEYS, F.round(F.lit(FINE[2]) * F.col("v") + F.lit(BROAD[2]) * F.col("_w")).alias("v"))
    both = chunks.from_pixels(blend, scenes, "v", tile)
    soft = chunks.to_pixels(chunks.gaussian(both, SIGMA)).withColumnRenamed("v", "_s")
    sharp = chunks.to_pixels(both).join(soft, KEYS).select(*KEYS, F.floor(F.least(F.greatest(F.lit(AMOUNT) * F.col("v") - F.lit(AMOUNT - 1) * F.col("_s"), F.lit(0)), F.lit(255))).alias("_l"))
    back = color.from_lab(F.col("_l") * 100 / 255, F.col("_a") - 128, F.col("_b") - 128)
    whole = (F.round(F.least(F.greatest(x, F.lit(0)), F.lit(1)) * 255).alias(n) for n, x in zip(BANDS, back, strict=True))
    return lab.drop("v").join(sharp, KEYS).select(*KEYS, *whole)


def top_scaled(values: DataFrame, top: float) -> DataFrame:
    """v over a percentile of its raster, 0..1."""
    return stretch.percentile_scale(values, top).select(*KEYS, F.col("p").alias("v"))


def surface(bands: DataFrame, prediction: DataFrame, scenes: DataFrame, tile: int = chunks.TILE) -> DataFrame:
    """What is shown: prediction and ridges of the gray image, fused, smoothed and scaled."""
    gray = bands.select(*KEYS, (F.round(color.gray(*(F.col(x) for x in BANDS))) / 255).alias("v"))
    found = chunks.to_pixels(chunks.frangi(chunks.from_pixels(gray, scenes, "v", tile), SCALES, dark=True))
    # the outermost pixels have no ridge
    ridges = gray.select(*KEYS).join(found, KEYS, "left").fillna(0.0, ["v"])
    norm = top_scaled(written(ridges, "ridges"), RIDGE_TOP).withColumnRenamed("v", "p")
    fused = stretch.fuse(prediction, norm, W_PREDICTION, W_RIDGES).withColumnRenamed("p", "v")
    smooth = chunks.to_pixels(chunks.gaussian(chunks.from_pixels(fused, scenes, "v", tile), SMOOTH, mirror_edge=True))
    return top_scaled(written(smooth, "surface"), TOP)


def predicted(bands: DataFrame, scenes: DataFrame, predict: Predict = evidence.probability, tile: int = chunks.TILE) -> tuple[DataFrame, DataFrame]:
    """Bands of clear contrast, and the prediction from them."""
    clear = written(contrast(bands, scenes, tile), "contrast")
    return clear, written(predict(clear, scenes), "prediction")


def roads(prediction: DataFrame, scenes: DataFrame, main: float = 0.50, all_: float = 0.20, smooth: float = 0.5, area: int = 20, tile: int = chunks.TILE) -> dict[str, DataFrame]:
    """main and secondary: centre lines at the high threshold, and those at the low one that are not of them; overlay: both,
    two pixels wide. They come from the prediction itself, and without closing, so that dense blocks do not fill up."""
    soft = chunks.gaussian(chunks.from_pixels(prediction, scenes, "p", tile), smooth, mirror_edge=True)
    prob = written(chunks.to_pixels(soft).withColumnRenamed("v", "p"), "smooth")
    bright, dim = (written(skeleton.centerlines(prob, t, area), "lines") for t in (main, all_))
    secondary = mask.subtract(dim, bright)
    return {"main": bright, "secondary": secondary, "overlay": mask.union(mask.dilate_down_right(bright, scenes), mask.dilate_down_right(secondary, scenes))}


def exact_heatmap(bands: DataFrame, scenes: DataFrame, predict: Predict = evidence.probability, tile: int = chunks.TILE, **limits) -> dict[str, DataFrame]:
    """heat: the surface; and the :func:`roads` of the prediction."""
    clear, prediction = predicted(bands, scenes, predict, tile)
    return {"heat": surface(clear, prediction, scenes, tile), **roads(prediction, scenes, tile=tile, **limits)}
