"""Ground sample distance, checks and summaries of scenes, as expressions over a catalog.

Defined results: without a transform the distance is null; a scene that fails a check has ok = false
and says why, coarse or unplaced ones are only warned about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres in a degree, the width of a road of twenty feet, coarsest reliable distance (fixed values).
DEGREE_M, ROAD_M, RELIABLE = 111139.0, 6.096, 3.5


def gsd() -> Column:
    """Mean of both pixel sizes in metres; sizes in degrees are scaled at the scene's middle latitude."""
    w, h = F.abs("t_a"), F.abs("t_e")
    middle = F.col("t_f") + F.col("t_e") * F.col("height") / 2.0
    degrees = (w * F.lit(DEGREE_M) * F.cos(F.radians(middle)) + h * F.lit(DEGREE_M)) / 2.0
    return F.when(F.col("projected") | (w >= 0.01), (w + h) / 2.0).otherwise(degrees)


def gsd_series() -> Column:
    """The same by the series of the ellipsoid, for geographic scenes."""
    phi = F.radians(F.col("t_f") + F.col("t_e") * F.col("height") / 2.0)
    x, y = F.lit(111412.84) * F.cos(phi), F.lit(111132.954) - F.lit(559.822) * F.cos(2 * phi)
    return F.when(F.col("projected"), (F.abs("t_a") + F.abs("t_e")) / 2.0).otherwise((F.abs("t_a") * x + F.abs("t_e") * y) / 2.0)


def described(scenes: DataFrame) -> DataFrame:
    """The catalog with gsd, the pixels across a road, and whether widths can be relied on."""
    return scenes.withColumn("gsd", gsd()).withColumns({"road_px": F.lit(ROAD_M) / F.greatest("gsd", F.lit(1e-6)), "reliable": F.col("gsd") <= RELIABLE})


def checked(scenes: DataFrame, coarsest: float = 5.0) -> DataFrame:
    """raster_id, ok, error and warning of each scene."""
    error = F.when((F.col("width") <= 0) | (F.col("height") <= 0), "no pixels").when(F.col("count") < 1, "no bands")
    warning = F.when(F.col("gsd") > coarsest, "coarse").when(F.col("srid").isNull(), "no reference system")
    return scenes.withColumn("gsd", gsd()).select("raster_id", error.isNull().alias("ok"), error.alias("error"), warning.alias("warning"))


def fine_enough(scenes: DataFrame, coarsest: float = 0.80) -> DataFrame:
    """The catalog; an error when the query runs if a scene is coarser than allowed."""
    return scenes.withColumn("gsd", gsd_series()).withColumn("gsd", F.when(F.col("gsd") > coarsest, F.raise_error(F.lit("the scene is too coarse")).cast("double")).otherwise(F.col("gsd")))


def summary(scenes: DataFrame) -> DataFrame:
    """What is reported of each scene: sizes, system, bounds and ground distance, rounded."""
    from gridloom.functions.geometry import bounds

    d = described(scenes)
    return d.select(
        "raster_id", F.concat_ws(" x ", "width", "height").alias("dimensions"), F.col("count").alias("bands"),
        F.coalesce(F.concat(F.lit("EPSG:"), F.col("srid").cast("string")), F.lit("None (Unreferenced)")).alias("crs"), "projected",
        F.round("gsd", 4).alias("gsd_m"), F.array(*(F.round(bounds()[k], 4) for k in ("west", "south", "east", "north"))).alias("bounds"),
        F.round("road_px", 2).alias("pixels_for_6_1m_road"), F.col("reliable").alias("gsd_reliable"),
    )


def report(scenes: DataFrame) -> DataFrame:
    """The same as lines of text."""
    s = summary(scenes)
    lines = [F.format_string("%-22s %s", F.lit(c), F.col(c).cast("string")) for c in s.columns if c not in ("raster_id", "bounds")]
    lines.append(F.format_string("%-22s %s", F.lit("bounds"), F.array_join(F.col("bounds").cast("array<string>"), ", ")))
    return s.select("raster_id", F.array_join(F.array(*lines), "\n").alias("text"))


def bands_kept(scenes: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """raster_id and band of the wanted bands (from 1) that a scene has; of no valid wish, its first three."""
    have = F.sequence(F.lit(1), F.col("count"))
    asked = F.filter(F.array(*map(F.lit, wanted or [0])), lambda b: (b >= 1) & (b <= F.col("count")))
    kept = F.when(F.size(asked) > 0, asked).otherwise(F.slice(have, 1, 3))
    return scenes.filter("count >= 1").select("raster_id", F.explode(kept).alias("band"))


def preview(scenes: DataFrame, largest: int = 2048) -> DataFrame:
    """The window that a preview shows: the first pixels of a scene, up to so many a side."""
    return scenes.select("raster_id", F.least("width", F.lit(largest)).alias("width"), F.least("height", F.lit(largest)).alias("height"))
