"""New and removed roads: the parts of a line beyond a distance of every line of the other snapshot.

Roads are exploded to segments, and candidates meet in an equality join on grid cells. A segment's
part inside the buffer (all points within a distance: a capsule) of another one is one interval of
its parameter, as capsules are convex; what no interval covers is stitched over consecutive segments.
Windows are over the segments of one road only.

Defined results: segments without length are left out; a road far from all others is one part; an
empty snapshot makes every road of the other one a change; null geometries give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import reproject

CELL = 64.0


def segments(roads: DataFrame) -> DataFrame:
    """(road_id, k, ax, ay, bx, by, len) of all segments with a length."""
    s = roads.select("road_id", F.posexplode(F.arrays_zip(F.slice("geom", 1, F.greatest(F.size("geom") - 1, F.lit(0))).alias("a"), F.slice("geom", 2, F.greatest(F.size("geom") - 1, F.lit(0))).alias("b"))).alias("k", "s"))
    s = s.select("road_id", "k", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    return s.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).filter("len > 0")


def _cells(s: DataFrame, grow: float) -> DataFrame:
    """Segments with each grid cell that they come within ``grow`` of (and few more): column by column, so that
    a long slanting segment has as many cells as it crosses, not as its bounding box holds."""
    col = F.col
    west, east = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = s.withColumn("gx", F.explode(F.sequence(F.floor((west - grow) / CELL), F.floor((east + grow) / CELL))))
    # the part of the segment inside the column and grow around it
    slope = F.when(col("ax") == col("bx"), F.lit(None)).otherwise((col("by") - col("ay")) / (col("bx") - col("ax")))
    columns = columns.withColumns({"_m": slope, "_x0": F.least(F.greatest(col("gx") * CELL - grow, west), east), "_x1": F.least(F.greatest((col("gx") + 1) * CELL + grow, west), east)})
    y0, y1 = (F.coalesce(col("ay") + (col(x) - col("ax")) * col("_m"), col(y)) for x, y in (("_x0", "ay"), ("_x1", "by")))
    rows = columns.withColumns({"_y0": y0, "_y1": y1})
    rows = rows.withColumn("gy", F.explode(F.sequence(F.floor((F.least("_y0", "_y1") - grow) / CELL), F.floor((F.greatest("_y0", "_y1") + grow) / CELL))))
    return rows.drop("_m", "_x0", "_x1", "_y0", "_y1")


def covered(a: DataFrame, b: DataFrame, buffer: float) -> DataFrame:
    """(road_id, k, lo, hi): intervals of the segments of a inside the buffer of a segment of b.

    A pair that shares several cells gives its interval for each of them, which changes no union and
    takes no shuffle of the pairs. The intervals are worked out on whole Arrow batches: as expressions
    they outgrow what can be compiled."""
    other = _cells(b, buffer).select("gx", "gy", *(F.col(x).alias("c" + x) for x in ("ax", "ay", "bx", "by", "len")))

    def near(lo: str, hi: str) -> Column:
        return (F.least(lo, hi) <= F.greatest("c" + lo, "c" + hi) + buffer) & (F.least("c" + lo, "c" + hi) <= F.greatest(lo, hi) + buffer)

    p = _cells(a, 0.0).join(other, ["gx", "gy"]).filter(near("ax", "bx") & near("ay", "by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = capsule_interval(*(c.to_numpy() for c in batch.columns[2:]), buffer)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lo), pa.array(hi)], ["road_id", "k", "lo", "hi"])

    wanted = p.select(F.col("road_id").cast("long").alias("road_id"), F.col("k").cast("int").alias("k"), "ax", "ay", "bx", "by", "cax", "cay", "cbx", "cby")
    return wanted.mapInArrow(run, "road_id long, k int, lo double, hi double").filter("hi > lo")


def capsule_interval(ax, ay, bx, by, cax, cay, cbx, cby, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The part lo..hi of each segment a-b (as shares of it) within r of the segment c; lo > hi where there is none.

    A capsule is a box along its segment and a disc about each end; it is convex, so the parts
    inside the three pieces make one interval."""
    dx, dy, ex, ey = bx - ax, by - ay, cbx - cax, cby - cay
    length = np.hypot(ex, ey)
    ux, uy, ox, oy = ex / length, ey / length, ax - cax, ay - cay

    def between(start, slope, low, high):
        flat, inside = np.abs(slope) < 1e-12, (start >= low) & (start <= high)
        x, y = (low - start) / np.where(flat, 1.0, slope), (high - start) / np.where(flat, 1.0, slope)
        return np.where(flat, np.where(inside, 0.0, 2.0), np.minimum(x, y)), np.where(flat, np.where(inside, 1.0, -1.0), np.maximum(x, y))

    along, across = between(ox * ux + oy * uy, dx * ux + dy * uy, 0.0, length), between(oy * ux - ox * uy, dy * ux - dx * uy, -r, r)
    pieces = [(np.maximum(along[0], across[0]), np.minimum(along[1], across[1]))]
    for px, py in ((ox, oy), (ax - cbx, ay - cby)):
        q, m, n = dx * dx + dy * dy, dx * px + dy * py, px * px + py * py - r * r
        d = m * m - q * n
        root = np.sqrt(np.maximum(d, 0.0))
        pieces.append((np.where(d >= 0, (-m - root) / q, 2.0), np.where(d >= 0, (-m + root) / q, -1.0)))
    low = np.minimum.reduce([np.where(y >= x, x, 2.0) for x, y in pieces])
    high = np.maximum.reduce([np.where(y >= x, y, -1.0) for x, y in pieces])
    return np.maximum(low, 0.0), np.minimum(high, 1.0)


def uncovered(a: DataFrame, b: DataFrame, buffer: float) -> DataFrame:
    """(road_id, part, length_m, geom): what is left of the roads of a, as connected parts."""
    s = segments(a)
    ends = s.select("road_id", "k", F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"))
    inside = covered(s, segments(b), buffer).unionByName(ends)
    before = Window.partitionBy("road_id", "k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    gaps = inside.withColumn("g0", F.coalesce(F.max("hi").over(before), F.lit(0.0))).filter("lo > g0").select("road_id", "k", "g0", F.col("lo").alias("g1"))
    road = Window.partitionBy("road_id").orderBy("k", "g0")
    goes_on = (F.col("g0") == 0) & (F.lag("g1").over(road) == 1) & (F.lag("k").over(road) == F.col("k") - 1)
    gaps = gaps.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("new").over(road).cast("int"))
    g = gaps.join(s, ["road_id", "k"])

    def at(t: str) -> Column:
        return F.struct((F.col("ax") + F.col(t) * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col(t) * (F.col("by") - F.col("ay"))).alias("y"))

    parts = g.groupBy("road_id", "part").agg(F.sum((F.col("g1") - F.col("g0")) * F.col("len")).alias("length_m"), F.array_sort(F.collect_list(F.struct("k", "g0", at("g0").alias("p"), at("g1").alias("q")))).alias("_s"))
    points = F.concat(F.slice(F.transform("_s", lambda x: x["p"]), 1, 1), F.transform("_s", lambda x: x["q"]))
    return parts.select("road_id", "part", "length_m", points.alias("geom"))


def changes_of(a: DataFrame, b: DataFrame, kind: str, buffer: float = 3.5, least: float = 20.0) -> DataFrame:
    """Parts of the roads of a of a least length that no road of b is near."""
    left = uncovered(a, b, buffer).filter(F.col("length_m") >= least)
    rows = left.join(a.select("road_id", "mean_width_m", "confidence"), "road_id")
    return rows.select(
        F.lit(kind).alias("change_type"), F.col("road_id").alias("source_id"), "part", F.round("length_m", 2).alias("length_m"),
        F.round("mean_width_m", 2).alias("width_m"), "confidence", "geom",
    )


def compare(before: DataFrame, after: DataFrame, buffer: float = 3.5, least: float = 20.0) -> DataFrame:
    """New and removed roads of two snapshots; BEFORE is brought to the system of AFTER where they differ."""
    if "srid" in before.columns and "srid" in after.columns:
        target = after.agg(F.max("srid")).first()[0]
        if target is not None and not before.filter(F.col("srid") != target).isEmpty():
            before = aligned(before, target)
    new = changes_of(after, before, "NEW_ROAD", buffer, least)
    return new.unionByName(changes_of(before, after, "REMOVED_ROAD", buffer, least))


def aligned(before: DataFrame, after_srid: int) -> DataFrame:
    """Geometries in another system."""
    return before.withColumn("geom", reproject(F.col("geom"), F.col("srid"), F.lit(after_srid))).withColumn("srid", F.lit(after_srid))
