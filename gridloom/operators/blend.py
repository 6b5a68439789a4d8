"""Blending overlapping tile predictions: a weighted mean, with partial sums on the map side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.stretch import clamp

FLOOR = 1e-6


def gaussian_weight(i: Column, j: Column, tile: int) -> Column:
    """A Gaussian with a quarter of the tile as sigma, 1 at the pixels next to the centre.

    Its unit-sum peak is floored at 1e-6, as for the sums: tiles beyond about 1,670 pixels stay below 1."""
    sigma, centre = tile / 4.0, (tile - 1) / 2.0
    line = [math.exp(-((k - centre) ** 2) / (2 * sigma**2)) for k in range(tile)]
    peak = (max(line) / sum(line)) ** 2
    scale = 1.0 / sum(line) ** 2 / max(peak, FLOOR)
    return F.exp(-((i - F.lit(centre)) ** 2 + (j - F.lit(centre)) ** 2) / F.lit(2 * sigma**2)) * F.lit(scale)


def blend(predictions: DataFrame, weight: Column | None = None) -> DataFrame:
    """p of each pixel from rows (raster_id, r, c, p) of all tiles that cover it."""
    w = weight if weight is not None else F.lit(1.0)
    sums = predictions.groupBy("raster_id", "r", "c").agg(F.sum(F.col("p") * w).alias("_p"), F.sum(w).alias("_w"))
    return sums.select("raster_id", "r", "c", clamp(F.col("_p") / F.greatest(F.col("_w"), F.lit(FLOOR))).alias("p"))


def blend_gaussian(predictions: DataFrame, tile: int) -> DataFrame:
    """Blend of rows that also hold their tile's row_off and col_off."""
    return blend(predictions, gaussian_weight(F.col("r") - F.col("row_off"), F.col("c") - F.col("col_off"), tile))


def blend_uniform(predictions: DataFrame) -> DataFrame:
    return blend(predictions)


def cover(scenes: DataFrame, blended: DataFrame) -> DataFrame:
    """All pixels of the scenes; those under no tile have probability 0."""
    pixels = scenes.select("raster_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"), "width")
    pixels = pixels.select("raster_id", "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    return pixels.join(blended, ["raster_id", "r", "c"], "left").fillna(0.0, ["p"])
