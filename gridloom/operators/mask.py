"""Masks as relations of foreground pixels: thresholds, morphology, set algebra, change.

Morphology works on the sparse relation where it can. Dilation by a rectangle explodes a pixel along
one axis at a time and removes repeats (partial aggregation first); erosion is a count of foreground
neighbours along one axis at a time, with the border of the raster counted as foreground. Neither
needs background rows or windows over whole rows of a raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["raster_id", "r", "c"]

#: Offsets of the 3 x 3 elliptic kernel: a plus sign.
PLUS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def threshold(prob: DataFrame, t: float = 0.35, strict: bool = False) -> DataFrame:
    """Pixels with p >= t (or p > t). A null or NaN is never foreground."""
    p = F.col("p")
    return prob.filter(~F.isnan(p) & ((p > t) if strict else (p >= t))).select(*KEYS)


def width_band(widths: DataFrame, low: float = 4.5, high: float = 7.5) -> DataFrame:
    """Rows with a width w in a band, both ends included."""
    return widths.filter(F.col("w").between(low, high))


def _inside(size: DataFrame | None, mask: DataFrame) -> DataFrame:
    return mask if size is None else mask.join(size.select("raster_id", "width", "height"), "raster_id").filter("r >= 0 and c >= 0 and r < height and c < width").select(*KEYS)


def _axis(mask: DataFrame, axis: str, before: int, after: int) -> DataFrame:
    shifted = mask.withColumn("_d", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn(axis, (F.col(axis) + F.col("_d")).cast("int"))
    return shifted.select(*KEYS).distinct()


def dilate(mask: DataFrame, scenes: DataFrame | None, radius: int = 1) -> DataFrame:
    """Dilation by a square of side 2 * radius + 1, inside the scenes (raster_id, width, height)."""
    return _inside(scenes, _axis(_axis(mask, "r", radius, radius), "c", radius, radius))


def dilate_down_right(mask: DataFrame, scenes: DataFrame | None) -> DataFrame:
    """Dilation by a 2 x 2 square that grows to the right and below."""
    return _inside(scenes, _axis(_axis(mask, "r", 0, 1), "c", 0, 1))


def dilate_line(mask: DataFrame, scenes: DataFrame | None, width: int) -> DataFrame:
    """Dilation by a square of any side; an even one reaches one pixel further up and to the left."""
    before = width // 2
    after = width - 1 - before
    return _inside(scenes, _axis(_axis(mask, "r", before, after), "c", before, after))


def _eroded_axis(mask: DataFrame, scenes: DataFrame, axis: str, size: str, radius: int) -> DataFrame:
    """Pixels whose whole run along the axis, cut at the border, is foreground."""
    spread = mask.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(axis, (F.col(axis) + F.col("_d")).cast("int"))
    counts = spread.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    need = F.least(F.col(axis) + radius, F.col(size) - 1) - F.greatest(F.col(axis) - radius, F.lit(0)) + 1
    return counts.join(scenes.select("raster_id", size), "raster_id").filter((F.col(axis) >= 0) & (F.col(axis) < F.col(size)) & (F.col("_n") == need)).select(*KEYS)


def erode(mask: DataFrame, scenes: DataFrame, radius: int = 1) -> DataFrame:
    """Erosion by a square; the border of the scene does not erode."""
    return _eroded_axis(_eroded_axis(mask, scenes, "r", "height", radius), scenes, "c", "width", radius)


def close(mask: DataFrame, scenes: DataFrame, radius: int = 2, iterations: int = 1) -> DataFrame:
    """n dilations, then n erosions: one of each with n times the radius."""
    return erode(dilate(mask, scenes, radius * iterations), scenes, radius * iterations)


def open_(mask: DataFrame, scenes: DataFrame, radius: int = 1, iterations: int = 1) -> DataFrame:
    return dilate(erode(mask, scenes, radius * iterations), scenes, radius * iterations)


def close_open(mask: DataFrame, scenes: DataFrame, close_radius: int = 2, open_radius: int = 1) -> DataFrame:
    """Closing, then opening unless its radius is 0."""
    closed = close(mask, scenes, close_radius)
    return open_(closed, scenes, open_radius) if open_radius > 0 else closed


def dilate_plus(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """Dilation by the plus-shaped kernel."""
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in PLUS))
    moved = mask.withColumn("_d", F.explode(offsets)).select("raster_id", (F.col("r") + F.col("_d.dr")).cast("int").alias("r"), (F.col("c") + F.col("_d.dc")).cast("int").alias("c"))
    return _inside(scenes, moved.distinct())


def erode_plus(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """Erosion by the plus-shaped kernel; the border does not erode."""
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in PLUS))
    moved = mask.withColumn("_d", F.explode(offsets)).select("raster_id", (F.col("r") + F.col("_d.dr")).cast("int").alias("r"), (F.col("c") + F.col("_d.dc")).cast("int").alias("c"))
    counts = moved.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    missing = F.lit(0)
    for test in (F.col("r") == 0, F.col("c") == 0, F.col("r") == F.col("height") - 1, F.col("c") == F.col("width") - 1):
        missing = missing + test.cast("int")
    sized = counts.join(scenes.select("raster_id", "width", "height"), "raster_id").filter("r >= 0 and c >= 0 and r < height and c < width")
    return sized.filter(F.col("_n") == F.lit(len(PLUS)) - missing).select(*KEYS)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).unionByName(b.select(*KEYS)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).join(b.select(*KEYS), KEYS, "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).join(b.select(*KEYS), KEYS, "left_anti")


def resize_nearest(mask: DataFrame, h_from: int, w_from: int, h_to: int, w_to: int) -> DataFrame:
    """Nearest-neighbour resize: each target pixel takes the source pixel at floor(i * from / to)."""

    def span(i: str, n_from: int, n_to: int) -> Column:
        at = F.col(i).cast("long")  # as an int, at * n_to overflows beyond 53,510 rows made three quarters
        low = F.ceil(at * n_to / F.lit(float(n_from)))
        high = F.ceil((at + 1) * n_to / F.lit(float(n_from))) - 1
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))

    rows = mask.withColumn("_r", F.explode(span("r", h_from, h_to))).withColumn("_c", F.explode(span("c", w_from, w_to)))
    return rows.select("raster_id", F.col("_r").cast("int").alias("r"), F.col("_c").cast("int").alias("c"))


def raster_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pixels that are in one mask only, by kind of change."""
    new = subtract(after, before).withColumn("change_type", F.lit("New_Road_Constructed"))
    gone = subtract(before, after).withColumn("change_type", F.lit("Road_Decommissioned"))
    return new.unionByName(gone)


def crop_border(raster: DataFrame, scenes: DataFrame, top: int = 50, bottom: int = 45, side: int = 15, least: int = 300) -> DataFrame:
    """Without the borders of large scenes, counted from 0 again: top and bottom where the height
    exceeds ``least``, both sides where the width does as well and something was cut below."""
    s = raster.join(scenes.select("raster_id", "width", "height"), "raster_id")
    tall = F.col("height") > least
    wide = tall & (F.col("width") > least) & F.lit(bottom > 0)
    t, b, d = F.when(tall, top).otherwise(0), F.when(tall, bottom).otherwise(0), F.when(wide, side).otherwise(0)
    s = s.filter((F.col("r") >= t) & (F.col("r") < F.col("height") - b) & (F.col("c") >= d) & (F.col("c") < F.col("width") - d))
    return s.withColumns({"r": (F.col("r") - t).cast("int"), "c": (F.col("c") - d).cast("int")}).drop("width", "height")


def stamp_discs(points: DataFrame, scenes: DataFrame | None, largest: int = 6) -> DataFrame:
    """A disc of radius ``radius`` (a column, up to ``largest``) around each pixel."""
    discs = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-largest, largest + 1) for b in range(-largest, largest + 1) if a * a + b * b <= largest**2))
    rows = points.withColumn("_d", F.explode(discs)).filter(F.col("_d.dr") * F.col("_d.dr") + F.col("_d.dc") * F.col("_d.dc") <= F.col("radius") * F.col("radius"))
    rows = rows.select("raster_id", (F.col("r") + F.col("_d.dr")).cast("int").alias("r"), (F.col("c") + F.col("_d.dc")).cast("int").alias("c")).distinct()
    return _inside(scenes, rows)


def boundary(mask: DataFrame) -> DataFrame:
    """Pixels with a missing neighbour among the four next to them."""
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in PLUS[1:]))
    near = mask.withColumn("_d", F.explode(offsets)).select("raster_id", (F.col("r") + F.col("_d.dr")).cast("int").alias("r"), (F.col("c") + F.col("_d.dc")).cast("int").alias("c"))
    full = near.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 4")
    return mask.join(full, KEYS, "left_anti").select(*KEYS)


def overlay(base: DataFrame, mask: DataFrame, value: float, opacity: float = 0.7) -> DataFrame:
    """Values of base with the mask painted over them."""
    marks = mask.select(*KEYS).distinct().withColumn("_in", F.lit(True))
    return base.join(marks, KEYS, "left").withColumn("v", F.when(F.col("_in"), F.col("v") * (1 - opacity) + F.lit(value * opacity)).otherwise(F.col("v"))).drop("_in")
