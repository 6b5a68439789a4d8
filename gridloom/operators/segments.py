"""Road segments: metrics of skeleton components, qualification and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Twenty feet in metres, and feet in a metre (fixed values).
TWENTY_FEET_M, FEET = 6.096, 3.28084


def qualifies(mean: Column, median: Column, length: Column, width_m: float = TWENTY_FEET_M, length_m: float = 15.0) -> Column:
    """Wide enough on average, or nearly so in the median, and long enough."""
    return ((mean >= width_m) | (median >= F.lit(width_m * 0.9))) & (length >= length_m)


def qualifies_feet(mean: Column, median: Column, top: Column, width_ft: float = 20.0) -> Column:
    """The permissive rule in feet: mean, 85 % in the median, or 125 % at the widest place."""
    return (mean >= width_ft) | (median >= F.lit(width_ft * 0.85)) | (top >= F.lit(width_ft * 1.25))


def segment_metrics(labels: DataFrame, distances: DataFrame, prob: DataFrame, gsd: float | DataFrame, width_m: float = TWENTY_FEET_M, length_m: float = 15.0, least: int = 3, coords: bool = True) -> DataFrame:
    """A row for each skeleton component of ``least`` pixels or more. Length is pixels times gsd, a number or a
    table (raster_id, gsd) with that of each scene.

    Pixels of a segment are listed in raster order. Widths and lengths are rounded to 2 places,
    confidence to 3; qualification is decided before rounding."""
    keys = ["raster_id", "r", "c"]
    rows = labels.join(distances, keys).join(prob.select(*keys, "p"), keys)
    rows = rows.join(gsd.select("raster_id", F.greatest("gsd", F.lit(1e-6)).alias("_g")), "raster_id") if isinstance(gsd, DataFrame) else rows.withColumn("_g", F.lit(max(gsd, 1e-6)))
    rows = rows.withColumn("w", F.lit(2.0) * F.col("dist") * F.col("_g"))
    aggs = [F.first("_g").alias("_g"), F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.percentile("w", F.lit(0.5)).alias("median"), F.min("w").alias("low"), F.max("w").alias("top"), F.avg("p").alias("conf")]
    if coords:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: F.struct(x["c"].alias("x"), x["r"].alias("y"))).alias("coords"))
    s = rows.groupBy("raster_id", "label").agg(*aggs).filter(F.col("n") >= least)
    length = F.col("n") * F.col("_g")
    out = s.select(
        "raster_id", F.col("label").alias("segment_id"), *(["coords"] if coords else []),
        F.round(length, 2).alias("length_m"), F.round("mean", 2).alias("mean_width_m"), F.round("median", 2).alias("median_width_m"),
        F.round("low", 2).alias("min_width_m"), F.round("top", 2).alias("max_width_m"),
        qualifies(F.col("mean"), F.col("median"), length, width_m, length_m).alias("qualifies"), F.round("conf", 3).alias("confidence"),
    )
    return out


def qualifying(segments: DataFrame) -> DataFrame:
    return segments.filter("qualifies")


def road_filter(segments: DataFrame, width_m: float = TWENTY_FEET_M, length_m: float = 15.0, confidence: float = 0.25) -> DataFrame:
    """Segments by their (rounded) mean width, length and confidence."""
    return segments.filter((F.col("mean_width_m") >= width_m) & (F.col("length_m") >= length_m) & (F.col("confidence") >= confidence))


def feet_metrics(labels: DataFrame, distances: DataFrame, gsd: float = 1.0, width_ft: float = 20.0, least: int = 4) -> DataFrame:
    """Widths in feet and lengths in km of components, their class and whether they qualify."""
    rows = labels.join(distances, ["raster_id", "r", "c"]).withColumn("w", F.lit(2.0) * F.col("dist") * F.lit(gsd) * F.lit(FEET))
    s = rows.groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_ft"), F.percentile("w", F.lit(0.5)).alias("median_ft"), F.max("w").alias("max_ft")).filter(F.col("n") >= least)
    ok = qualifies_feet(F.col("mean_ft"), F.col("median_ft"), F.col("max_ft"), width_ft)
    kind = F.when(~ok, "filtered").when(F.col("mean_ft") >= 40.0, "highway").otherwise("arterial")
    return s.withColumns({"length_km": F.col("n") * F.lit(gsd) / 1000.0, "qualifies": ok, "width_class": kind})


def totals(feet: DataFrame) -> DataFrame:
    """Numbers of segments, of those that qualify and do not, and the length that qualifies."""
    return feet.groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("qualifies").alias("qualified"), F.count_if(~F.col("qualifies")).alias("filtered"),
        F.coalesce(F.sum(F.when(F.col("qualifies"), F.col("length_km"))), F.lit(0.0)).alias("length_km"),
    )


def width_classes(feet: DataFrame) -> DataFrame:
    return feet.groupBy("raster_id", "width_class").agg(F.count(F.lit(1)).alias("segments"), F.sum("length_km").alias("length_km"))


def corridor_area(mask: DataFrame, gsd: float) -> DataFrame:
    return mask.groupBy("raster_id").agg((F.count(F.lit(1)) * F.lit(gsd * gsd)).alias("area_m2"))


def dice(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Dice loss of a probability against a 0/1 mask, both dense: 1 - (2 sum(pg) + 1) / (sum p + sum g + 1)."""
    t = truth.select("raster_id", "r", "c", F.col("v").alias("g"))
    j = pred.join(t, ["raster_id", "r", "c"])
    return j.groupBy("raster_id").agg((F.lit(1.0) - (2 * F.sum(F.col("p") * F.col("g")) + 1) / (F.sum("p") + F.sum("g") + 1)).alias("dice_loss"))


def bce(pred: DataFrame, truth: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Mean binary cross entropy of a probability against a 0/1 mask, both dense."""
    t = truth.select("raster_id", "r", "c", F.col("v").alias("g"))
    p = F.least(F.greatest("p", F.lit(eps)), F.lit(1 - eps))
    return pred.join(t, ["raster_id", "r", "c"]).groupBy("raster_id").agg(F.avg(-(F.col("g") * F.log(p) + (1 - F.col("g")) * F.log(1 - p))).alias("bce"))


def contour_widths(labels: DataFrame, border: DataFrame, widths: DataFrame) -> DataFrame:
    """Mean width w over the border pixels of each component."""
    keys = ["raster_id", "r", "c"]
    rows = labels.join(border, keys, "left_semi").join(widths.select(*keys, "w"), keys)
    return rows.groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("pixels"), F.avg("w").alias("mean_w"))
