"""Exact Euclidean distance of foreground pixels to the background.

First the distance to the nearest background pixel of the column, from the ends of its foreground
runs; then the smallest ``(c - c')^2 + g(c')^2`` along the row, as the lower envelope of the row's
parabolas, in time that grows with the width of the row alone. The border of a scene is not background.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distance(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """(raster_id, r, c, dist) of every foreground pixel; null where a raster has no background."""
    keys = ["raster_id", "r", "c"]
    m = mask.select(F.col("raster_id").cast("long").alias("raster_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).join(scenes.select("raster_id", "width", "height"), "raster_id")
    # runs of consecutive foreground pixels of a column
    down = Window.partitionBy("raster_id", "c").orderBy("r")
    runs = m.withColumn("_run", F.col("r") - F.row_number().over(down))
    ends = Window.partitionBy("raster_id", "c", "_run")
    top, bottom = F.min("r").over(ends), F.max("r").over(ends)
    up = F.when(top > 0, F.col("r") - top + 1)
    low = F.when(bottom < F.col("height") - 1, bottom - F.col("r") + 1)
    column = runs.select(*keys, "width", F.least(up, low).alias("g"))
    # rows of a scene are dealt to tasks; a row holds as many pixels as the scene is wide
    rows = column.groupBy("raster_id", "r").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("c", "g"))).alias("row"))
    found = rows.mapInArrow(_along_rows, "raster_id long, r int, c array<int>, dist array<double>")
    return found.select("raster_id", "r", F.explode(F.arrays_zip("c", "dist")).alias("p")).select("raster_id", "r", "p.c", "p.dist")


def _along_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest (c - c')^2 + g(c')^2 along a row: from each place the parabola of its column, of which the
    lower envelope is found in one walk. Places without a foreground pixel have g = 0."""
    for batch in batches:
        out_c, out_d = [], []
        for width, row in zip(batch.column("width").to_pylist(), batch.column("row").to_pylist(), strict=True):
            c = np.array([p["c"] for p in row])
            square = np.zeros(width)
            square[c] = [np.inf if p["g"] is None else float(p["g"]) ** 2 for p in row]
            out_c.append(c.astype(np.int32))
            out_d.append(np.sqrt(_envelope(square))[c])
        dist = [[None if np.isinf(x) else x for x in d] for d in out_d]
        yield pa.RecordBatch.from_arrays([batch.column("raster_id"), batch.column("r"), pa.array(out_c, pa.list_(pa.int32())), pa.array(dist, pa.list_(pa.float64()))], ["raster_id", "r", "c", "dist"])


def _envelope(height: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(np.isfinite(height))
    if not len(at):
        return height
    tops, starts = [int(at[0])], [-np.inf]
    for c in map(int, at[1:]):
        while True:
            t = tops[-1]
            meet = ((height[c] + c * c) - (height[t] + t * t)) / (2 * (c - t))
            if meet > starts[-1]:
                break
            tops.pop()
            starts.pop()
        tops.append(c)
        starts.append(meet)
    place = np.arange(len(height))
    best = np.array(tops)[np.searchsorted(starts, place, side="right") - 1]
    return (place - best) ** 2 + height[best]


def widths(distances: DataFrame, gsd: float, feet: bool = False) -> DataFrame:
    """Width w of the road at each pixel: twice the distance, in metres or feet."""
    return distances.withColumn("w", F.lit(2.0) * F.col("dist") * F.lit(max(gsd, 1e-6)) * F.lit(3.28084 if feet else 1.0))
