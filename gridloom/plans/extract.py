"""From a raster to road segments: tiles, prediction, blending, mask, components, widths, lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import pixel_to_world
from gridloom.operators import blend, components, distance, mask, segments, skeleton, stretch, tiling

#: A predictor takes rows (raster_id, tile_id, r, c, row_off, col_off, v) and gives them with p in 0..1.
Predictor = Callable[[DataFrame], DataFrame]


def tile_range(rows: DataFrame) -> DataFrame:
    """The default predictor: values between the extremes of their tile. Others are functions, or wrap
    ``pyspark.ml.functions.predict_batch_udf``."""
    tile = Window.partitionBy("raster_id", "tile_id")
    ends = rows.withColumns({"_lo": F.min("v").over(tile), "_hi": F.max("v").over(tile)})
    return ends.withColumn("p", stretch.stretch(F.col("v"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


PREDICTORS: dict[str, Predictor] = {"tile_range": tile_range}


def predictor(name: str) -> Predictor:
    return PREDICTORS.get(name.lower(), tile_range)


def tiled(raster: DataFrame, scenes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Pixels with each tile that covers them: a pixel finds its tiles by arithmetic, not by a range join.

    Tile k of an axis begins at k * stride, the last one at the last place where it fits. The tiles over a pixel follow
    each other, so two numbers give them, whatever the size of the scene."""
    stride = max(1, tile - overlap)
    sized = raster.join(scenes.select("raster_id", "width", "height"), "raster_id")

    def covering(at: str, size: str):
        last = F.greatest(F.col(size) - tile, F.lit(0))
        end = F.ceil(last / stride).cast("int")
        first = F.least(F.greatest(F.ceil((F.col(at) - tile + 1) / stride).cast("int"), F.lit(0)), end)
        return F.sequence(first, F.when(F.col(at) < last, F.floor(F.col(at) / stride).cast("int")).otherwise(end)), last, end

    (rows, low, _), (cols, right, across) = covering("r", "height"), covering("c", "width")
    e = sized.withColumn("_i", F.explode(rows)).withColumn("_j", F.explode(cols))
    e = e.withColumns({"row_off": F.least(F.col("_i") * stride, low), "col_off": F.least(F.col("_j") * stride, right), "tile_id": (F.col("_i") * (across + 1) + F.col("_j")).cast("int")})
    inside = (F.col("r") < F.col("row_off") + tile) & (F.col("c") < F.col("col_off") + tile)
    return e.filter(inside).select("raster_id", "tile_id", "r", "c", "row_off", "col_off", "v")


def probability(raster: DataFrame, scenes: DataFrame, tile: int = 512, overlap: int = 128, predict: Predictor = tile_range, uniform: bool = False) -> DataFrame:
    """Blended probability of every pixel."""
    rows = predict(tiled(raster, scenes, tile, overlap))
    return blend.blend_uniform(rows) if uniform else blend.blend_gaussian(rows, tile)


def clean_mask(prob: DataFrame, scenes: DataFrame, t: float = 0.35, area: int = 15, close_radius: int = 2, open_radius: int = 1) -> DataFrame:
    """Threshold, closing, opening, shape filter."""
    m = mask.close_open(mask.threshold(prob, t), scenes, close_radius, open_radius)
    labels = components.label(m)
    return components.write_back(labels, components.shape_filter(components.stats(labels), area))


def road_segments(m: DataFrame, prob: DataFrame, scenes: DataFrame, gsd: float | DataFrame, **limits) -> DataFrame:
    """Metrics of the segments of a mask's skeleton."""
    return segments.segment_metrics(components.label(skeleton.skeleton(m)), distance.distance(m, scenes), prob, gsd, **limits)


def lines(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """Segments as lines in the scene's system."""
    from gridloom.functions.geometry import is_line

    s = found.join(scenes.select("raster_id", "srid", *(f"t_{k}" for k in "abcdef")), "raster_id")

    def point(p):
        x, y = pixel_to_world(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    rows = s.withColumn("geom", F.transform("coords", point)).filter(is_line(F.col("geom")))
    return rows.select(F.col("segment_id").alias("road_id"), "length_m", "mean_width_m", "median_width_m", "min_width_m", "max_width_m", "confidence", "qualifies", "geom", "srid")


def extract(raster: DataFrame, scenes: DataFrame, gsd: float | DataFrame, tile: int = 512, overlap: int = 128, predict: Predictor = tile_range, t: float = 0.35) -> DataFrame:
    """The whole chain; qualifying segments only."""
    from gridloom.session import written

    prob = written(probability(raster, scenes, tile, overlap, predict), "probability")
    m = written(clean_mask(prob, scenes, t), "mask")
    return segments.qualifying(road_segments(m, prob, scenes, gsd))
