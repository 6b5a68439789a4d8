"""Percentiles, stretches and fusion of pixel values.

Percentiles are exact with linear interpolation. Inside a tile, whose size is bounded, Spark's own
aggregate holds all values; over a whole raster they are found by ranks in a histogram, so that no
task holds more than the pixels of one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def raster_percentiles(values: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, as columns named by ps, for groups of any size.

    One pass counts values in bins between each group's extremes; a second ranks only the values of
    the bins that hold the wanted ranks."""
    v = values.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = v.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    place = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS)).otherwise(F.lit(0)).cast("int")
    binned = v.join(ends, keys).withColumn("_bin", place)
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(p) * (F.col("_n") - 1)), F.ceil(F.lit(p) * (F.col("_n") - 1))) for p in ps.values()))))
    held = counts.withColumn("_before", before).withColumn("_ranks", F.filter(ranks, lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_k")))).filter(F.size("_ranks") > 0)
    # equal values of a bin are counted first: one value may fill it
    found = binned.join(held.select(*keys, "_bin", "_before", "_ranks"), [*keys, "_bin"])
    found = found.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_m"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"), F.first("_n").alias("_n"))
    last = F.sum("_m").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    found = found.withColumn("_last", last).withColumn("_rank", F.explode(F.filter("_ranks", lambda x: (x < F.col("_last")) & (x >= F.col("_last") - F.col("_m")))))
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"), F.max("_n").alias("_n"))

    def percentile(p: float) -> Column:
        at = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col("_at")[F.floor(at)], F.col("_at")[F.ceil(at)]
        return low + (high - low) * (at - F.floor(at))

    return by_rank.select(*keys, *(percentile(p).alias(name) for name, p in ps.items()))


def tile_percentiles(values: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """The same for groups of bounded size, such as tiles."""
    return values.groupBy(*keys).agg(*(F.percentile(value, F.lit(p)).alias(name) for name, p in ps.items()))


def stretch(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low) in 0..1, and 0 where there is no range."""
    return F.when(high <= low, F.lit(0.0)).otherwise(clamp((v - low) / (high - low)))


def percentile_stretch(raster: DataFrame, keys: list[str] | None = None, low: float = 0.02, high: float = 0.98, bounded: bool = False) -> DataFrame:
    """Values between two percentiles of their raster (or tile, band) brought to 0..1, as p."""
    keys = keys or ["raster_id"]
    ends = (tile_percentiles if bounded else raster_percentiles)(raster, keys, "v", {"_lo": low, "_hi": high})
    return raster.join(ends, keys).withColumn("p", stretch(F.col("v"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def minmax_stretch(raster: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Values between the extremes of their raster brought to 0..1, as p."""
    keys = keys or ["raster_id"]
    ends = raster.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return raster.join(ends, keys).withColumn("p", stretch(F.col("v"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def percentile_scale(raster: DataFrame, p: float = 0.99, eps: float = 1e-8) -> DataFrame:
    """v over a high percentile of its raster, in 0..1."""
    top = raster_percentiles(raster, ["raster_id"], "v", {"_top": p})
    return raster.join(top, "raster_id").withColumn("p", clamp(F.col("v") / (F.col("_top") + F.lit(eps)))).drop("_top")


def to_uint8(raster: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values between two percentiles as 0..255, cut to whole numbers."""
    ends = raster_percentiles(raster, ["raster_id"], "v", {"_lo": low, "_hi": high})
    scaled = clamp((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-6)) * 255, 0.0, 255.0)
    return raster.join(ends, "raster_id").withColumn("u8", scaled.cast("int")).drop("_lo", "_hi")


def max_scale(raster: DataFrame) -> DataFrame:
    """v over the raster's maximum where that exceeds 255, else over 255."""
    top = raster.groupBy("raster_id").agg(F.max("v").alias("_top"))
    return raster.join(top, "raster_id").withColumn("p", F.col("v") / F.when(F.col("_top") > 255, F.col("_top")).otherwise(F.lit(255.0))).drop("_top")


def output_scale(p: Column, bits16: Column) -> Column:
    """0..1 to whole numbers of 8 or 16 bits, rounded."""
    return F.round(clamp(p) * F.when(bits16, F.lit(65535)).otherwise(F.lit(255))).cast("int")


def fuse(first: DataFrame, second: DataFrame, w_first: float, w_second: float) -> DataFrame:
    """Weighted sum of two co-registered rasters of p."""
    b = second.select("raster_id", "r", "c", F.col("p").alias("_q"))
    return first.join(b, ["raster_id", "r", "c"]).withColumn("p", F.lit(w_first) * F.col("p") + F.lit(w_second) * F.col("_q")).drop("_q")


def gated(p: Column, q: Column, w_p: float, w_q: float, gate: float) -> Column:
    """A weighted sum where q exceeds the gate, p elsewhere."""
    return F.when(q > gate, F.lit(w_p) * p + F.lit(w_q) * q).otherwise(p)


def replace_annotated(raster: DataFrame, annotated: DataFrame, background: DataFrame) -> DataFrame:
    """Annotated pixels take the background's value."""
    marks = annotated.select("raster_id", "r", "c").distinct().withColumn("_mark", F.lit(True))
    back = background.select("raster_id", "r", "c", F.col("v").alias("_back"))
    joined = raster.join(marks, ["raster_id", "r", "c"], "left").join(back, ["raster_id", "r", "c"], "left")
    return joined.withColumn("v", F.when(F.col("_mark"), F.coalesce("_back", "v")).otherwise(F.col("v"))).drop("_mark", "_back")
