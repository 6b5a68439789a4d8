"""Road probability from colour and edges: a predictor without a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.operators import mask, stencil
from gridloom.session import written

KEYS = ["raster_id", "r", "c"]
#: Points for either colour test and for an edge near by, edge thresholds, reach of an edge, and the smoothing.
COLOUR, EDGE, LOW, HIGH, REACH, RADIUS, SIGMA = 100.0, 55.0, 30.0, 90.0, 2, 4, 1.7


def bytes_of(bands: DataFrame, cols: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Bands of each raster between their extremes as whole numbers 0..255."""
    ends = bands.groupBy("raster_id").agg(*(f(c).alias(f"_{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    j = bands.join(ends, "raster_id")
    return j.select(*KEYS, *(F.floor((F.col(c) - F.col(f"_{c}_lo")) / (F.col(f"_{c}_hi") - F.col(f"_{c}_lo") + F.lit(1e-6)) * 255).cast("double").alias(c) for c in cols))


def points(bands: DataFrame, scenes: DataFrame) -> DataFrame:
    """(raster_id, r, c, v): points of every pixel from red, green and blue in 0..255."""
    r, g, b = F.col("red"), F.col("green"), F.col("blue")
    _, s, v = color.hsv8(r, g, b)
    light, a, bb = color.lab8(r, g, b)
    colour = bands.select(*KEYS, (F.when(color.asphalt_hsv(s, v), COLOUR).otherwise(0.0) + F.when(color.asphalt_lab(light, a, bb), COLOUR).otherwise(0.0)).alias("v"))
    near = mask.dilate(stencil.edges(bands.select(*KEYS, F.round(color.gray(r, g, b)).alias("v")), LOW, HIGH), scenes, REACH)
    return colour.join(near.withColumn("_edge", F.lit(EDGE)), KEYS, "left").select(*KEYS, (F.col("v") + F.coalesce("_edge", F.lit(0.0))).alias("v"))


def probability(bands: DataFrame, scenes: DataFrame) -> DataFrame:
    """(raster_id, r, c, p): points over the highest of the raster, smoothed."""
    found = written(points(written(bytes_of(bands), "bytes"), scenes), "points")
    top = found.groupBy("raster_id").agg(F.max("v").alias("_top"))
    share = found.join(top, "raster_id").select(*KEYS, F.when(F.col("_top") > 0, F.col("v") / F.col("_top")).otherwise(F.col("v")).alias("v"))
    return stencil.gaussian(share, scenes, SIGMA, RADIUS).select(*KEYS, F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0)).alias("p"))
