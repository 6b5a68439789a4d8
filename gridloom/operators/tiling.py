"""Tiles over rasters as column expressions: a scene is a row, a tile plan explodes it.

Offsets are arrays computed from the scene's size, so planning a million scenes is one narrow stage.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _int(x) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x))


def spread(rows: DataFrame) -> DataFrame:
    """Rows that each make much work, dealt out to as many tasks as a shuffle has: a small file is one task else.

    The number is given, so that adaptive execution does not join the small partitions again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def clamped_offsets(size, tile: int, overlap: int) -> Column:
    """Starts every ``tile - overlap`` pixels (1 at least), pulled back so that tiles stay inside; no start twice."""
    n, stride = _int(size), max(1, tile - overlap)
    last = F.greatest(n - tile, F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda x: F.least(x, last))))


def sliding_offsets(size, tile: int, stride: int, tail: str = "none") -> Column:
    """Starts every ``stride`` pixels. ``tail="append"`` adds the last possible start where pixels remain,
    ``"clamp"`` pulls the last ones back; ``"none"`` leaves the remainder uncovered."""
    n = _int(size)
    last = F.greatest(n - tile, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(stride))
    if tail == "none":
        return starts
    return F.array_sort(F.array_distinct(F.array_append(starts, last)))


def crop_offsets(size, crop: int, step: int, thresh: int) -> Column:
    """Starts every ``step``; the last start is added where more than ``thresh`` pixels would be left over."""
    n = _int(size)
    starts = F.sequence(F.lit(0), F.greatest(n - crop, F.lit(0)), F.lit(step))
    left = n - (F.element_at(starts, -1) + crop)
    return F.when(n < crop, F.array().cast("array<int>")).otherwise(F.when(left > thresh, F.array_append(starts, n - crop)).otherwise(starts))


def _grid(scenes: DataFrame, rows: Column, cols: Column, first_id: int = 0) -> DataFrame:
    """Each row start with each column start; ids in row-major order from the places in both arrays."""
    across = scenes.withColumn("_cols", cols).select("*", F.posexplode(rows).alias("_i", "row_off"))
    return across.select("*", F.posexplode("_cols").alias("_j", "col_off")).withColumn("tile_id", (F.col("_i") * F.size("_cols") + F.col("_j") + first_id).cast("int")).drop("_i", "_j", "_cols")


def windows(scenes: DataFrame, tile: int = 512, overlap: int = 128) -> DataFrame:
    """Overlapping tiles that cover each scene (raster_id, width, height)."""
    grid = _grid(scenes.select("raster_id", "width", "height"), clamped_offsets(F.col("height"), tile, overlap), clamped_offsets(F.col("width"), tile, overlap))
    return grid.select(
        "raster_id", "tile_id", "col_off", "row_off",
        F.least(F.lit(tile), F.col("width")).cast("int").alias("tile_width"),
        F.least(F.lit(tile), F.col("height")).cast("int").alias("tile_height"),
        F.col("width").alias("source_width"), F.col("height").alias("source_height"),
    )


def sliding(scenes: DataFrame, tile: int = 256, stride: int = 64, tail: str = "none") -> DataFrame:
    """Tiles with a fixed stride; scenes smaller than a tile get one tile of their own size."""
    grid = _grid(scenes.select("raster_id", "width", "height"), sliding_offsets(F.col("height"), tile, stride, tail), sliding_offsets(F.col("width"), tile, stride, tail))
    return grid.select("raster_id", "tile_id", "col_off", "row_off", F.least(F.lit(tile), F.col("width")).cast("int").alias("tile_width"), F.least(F.lit(tile), F.col("height")).cast("int").alias("tile_height"))


def crops(scenes: DataFrame, crop: int = 480, step: int = 240, thresh: int = 0) -> DataFrame:
    """Sub-images of a scene with numbers from 1 and their three-digit suffix."""
    grid = _grid(scenes.select("raster_id", "width", "height"), crop_offsets(F.col("height"), crop, step, thresh), crop_offsets(F.col("width"), crop, step, thresh), 1)
    return grid.select("raster_id", F.col("tile_id").alias("crop_id"), "col_off", "row_off", F.concat(F.lit("_s"), F.lpad(F.col("tile_id").cast("string"), 3, "0")).alias("suffix"))


def clip(tiles: DataFrame) -> DataFrame:
    """End of each tile inside its scene (exclusive)."""
    return tiles.withColumns({"row_end": F.least(F.col("row_off") + F.col("tile_height"), F.col("source_height")), "col_end": F.least(F.col("col_off") + F.col("tile_width"), F.col("source_width"))})


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """The pixels of each tile, clipped to the scene: no range join, each tile makes its own."""
    t = clip(tiles)
    t = t.select("*", F.explode(F.sequence(F.col("row_off"), F.col("row_end") - 1)).alias("r"))
    return t.select("*", F.explode(F.sequence(F.col("col_off"), F.col("col_end") - 1)).alias("c"))


def reflect(i: Column, n: Column) -> Column:
    """Index inside 0..n-1 of a place up to n - 1 beyond either border, mirrored without repeating the border."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    k = F.pmod(i, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.least(k, period - k)).cast("int")


def read_window(raster: DataFrame, scenes: DataFrame, col_off: int, row_off: int, width: int, height: int) -> DataFrame:
    """A window of each raster, clamped to its bounds and padded by reflection to the right and below.

    The bounds of the window reach the scan as a filter on r and c."""
    sized = scenes.select("raster_id", (F.least(F.col("width"), F.lit(col_off + width)) - F.lit(col_off)).alias("w"), (F.least(F.col("height"), F.lit(row_off + height)) - F.lit(row_off)).alias("h"))
    sized = sized.filter("w > 0 and h > 0")
    inside = raster.filter((F.col("r") >= row_off) & (F.col("r") < row_off + height) & (F.col("c") >= col_off) & (F.col("c") < col_off + width))
    want = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("wr")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("wc"))
    want = want.withColumns({"r": F.lit(row_off) + reflect(F.col("wr"), F.col("h")), "c": F.lit(col_off) + reflect(F.col("wc"), F.col("w"))})
    return want.join(inside, ["raster_id", "r", "c"]).select("raster_id", "wr", "wc", "v")


def halo_tiles(raster: DataFrame, tile: int, halo: int) -> DataFrame:
    """Pixels with the tiles that need them: their own, and those whose halo they lie in (``inner`` marks the owner)."""
    offsets = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    own_r, own_c = F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)
    rows = raster.withColumn("dr", F.explode(offsets)).withColumn("dc", F.explode(offsets))
    tr, tc = own_r + F.col("dr"), own_c + F.col("dc")
    near_r = (F.col("r") >= tr * tile - halo) & (F.col("r") < (tr + 1) * tile + halo)
    near_c = (F.col("c") >= tc * tile - halo) & (F.col("c") < (tc + 1) * tile + halo)
    rows = rows.withColumns({"tile_r": tr.cast("int"), "tile_c": tc.cast("int")}).filter(near_r & near_c & (F.col("tile_r") >= 0) & (F.col("tile_c") >= 0))
    return rows.withColumn("inner", (F.col("dr") == 0) & (F.col("dc") == 0)).drop("dr", "dc")


def pad_sizes(scenes: DataFrame, multiple: int) -> DataFrame:
    """Columns and rows that are missing to a multiple of a number."""
    return scenes.select("raster_id", F.pmod(F.lit(multiple) - F.col("width") % multiple, F.lit(multiple)).cast("int").alias("pad_w"), F.pmod(F.lit(multiple) - F.col("height") % multiple, F.lit(multiple)).cast("int").alias("pad_h"))


def batches(tiles: DataFrame, size: int = 4) -> DataFrame:
    """Number of the batch of each tile."""
    return tiles.withColumn("batch_id", F.floor(F.col("tile_id") / size).cast("int"))


def training_patches(scenes: DataFrame, patch: int = 128, stride: int = 32) -> DataFrame:
    """Patches with a fixed stride, each also mirrored left to right."""
    return sliding(spread(scenes.select("raster_id", "width", "height")), patch, stride).withColumn("flipped", F.explode(F.array(F.lit(False), F.lit(True))))


def flip_columns(pixels: DataFrame, width: Column | int) -> DataFrame:
    return pixels.withColumn("c", _int(width) - 1 - F.col("c"))


class TilePlan:
    """A table function: the tiles of one scene, for SQL (see :func:`register`)."""

    def eval(self, width: int, height: int, tile: int, overlap: int) -> Iterator[tuple[int, int, int, int, int]]:
        stride = max(1, tile - overlap)
        rows = sorted({min(x, max(0, height - tile)) for x in range(0, max(height, 1), stride)})
        cols = sorted({min(x, max(0, width - tile)) for x in range(0, max(width, 1), stride)})
        for k, (r, c) in enumerate((r, c) for r in rows for c in cols):
            yield k, c, r, min(tile, width), min(tile, height)


def register(spark) -> None:
    """``SELECT * FROM tile_plan(width, height, tile, overlap)``"""
    spark.udtf.register("tile_plan", F.udtf(TilePlan, returnType="tile_id int, col_off int, row_off int, tile_width int, tile_height int"))
