"""Outlines of mask regions as rings of points.

Every side of a pixel at which the neighbour is missing is a directed edge, with its pixel on the
right. An edge's follower begins where it ends; where two do, the one that turns right stays with
its pixel, so regions that touch at a corner only keep outlines of their own. The edges form cycles.
Which cycle an edge is in, and its place in it, are found by doubling: each round an edge learns
what the edge twice as far ahead knows, so rounds grow with the logarithm of the longest outline, and
no task walks an outline. Only corners are gathered, to the row that holds the finished ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import discard, written

KEYS = ["raster_id", "label"]
#: Sides of a pixel: where the neighbour is, where the edge begins, and its direction, clockwise from the top.
SIDES = (((-1, 0), (0, 0)), ((0, 1), (0, 1)), ((1, 0), (1, 1)), ((0, -1), (1, 0)))
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def edges(labels: DataFrame) -> DataFrame:
    """(raster_id, label, r, c, side, y, x, y2, x2): the edges of each component."""
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.lit(n[0]).alias("nr"), F.lit(n[1]).alias("nc"), F.lit(b[0]).alias("by"), F.lit(b[1]).alias("bx"), F.lit(STEPS[k][0]).alias("sy"), F.lit(STEPS[k][1]).alias("sx")) for k, (n, b) in enumerate(SIDES)))
    rows = labels.select(*KEYS, "r", "c", F.explode(sides).alias("s")).withColumns({"nr": F.col("r") + F.col("s.nr"), "nc": F.col("c") + F.col("s.nc")})
    there = labels.select("raster_id", "label", F.col("r").alias("nr"), F.col("c").alias("nc"))
    rows = rows.join(there, [*KEYS, "nr", "nc"], "left_anti")
    y, x = F.col("r") + F.col("s.by"), F.col("c") + F.col("s.bx")
    return rows.select(*KEYS, "r", "c", F.col("s.side").alias("side"), y.alias("y"), x.alias("x"), (y + F.col("s.sy")).alias("y2"), (x + F.col("s.sx")).alias("x2"))


def rings(labels: DataFrame) -> DataFrame:
    """(raster_id, label, ring, outer, perimeter, area, geom): the closed outlines of each component.

    Points are (x, y) in pixel corners; area is signed, positive for an outer ring and negative for a
    hole, so the areas of a component add up to its pixels."""
    e = edges(labels.select(*KEYS, "r", "c"))
    e = written(e.withColumn("id", (F.col("r").cast("long") * (1 << 22) + F.col("c")) * 4 + F.col("side")), "edges")
    ahead = e.select(*KEYS, F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("side").alias("side2"), F.col("id").alias("id2"))
    # 0: a turn to the right, 1: straight on, 2: a turn to the left
    turn = F.pmod(F.lit(1) - (F.col("side2") - F.col("side")), F.lit(4))
    nxt = e.join(ahead, [*KEYS, "y2", "x2"]).groupBy(*KEYS, "id").agg(F.min(F.struct(turn.alias("turn"), "id2")).alias("n"))
    # low: the smallest edge ahead, which names the ring
    now = written(nxt.select(*KEYS, "id", F.col("n.id2").alias("to"), (F.col("n.turn") != 1).alias("bends"), F.least("id", "n.id2").alias("low")), "rings")
    while True:
        far = now.select(*KEYS, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        step = written(now.join(far, [*KEYS, "to"]).select(*KEYS, "id", F.col("to2").alias("to"), "bends", F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("new")), "rings")
        discard(now)
        now = step
        if now.filter("new").isEmpty():
            break
    # left: edges from here to the end of the ring, which ends before its smallest edge
    ring = now.select(*KEYS, "id", F.col("low").alias("ring"), "bends")
    start = ring.join(nxt.select(*KEYS, "id", F.col("n.id2").alias("to")), [*KEYS, "id"])
    rank = written(start.select(*KEYS, "ring", "id", "bends", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to"), F.lit(1).cast("long").alias("left")), "ranks")
    discard(now)
    while not rank.filter("`to` is not null").isEmpty():
        far = rank.select(*KEYS, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        step = written(rank.join(far, [*KEYS, "to"], "left").select(*KEYS, "ring", "id", "bends", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")), "ranks")
        discard(rank)
        rank = step
    placed = rank.join(e, [*KEYS, "id"])
    cross = (F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2.0
    out = placed.groupBy(*KEYS, "ring").agg(
        F.count(F.lit(1)).alias("perimeter"), F.sum(cross).alias("area"),
        F.array_sort(F.collect_list(F.when(F.col("bends"), F.struct((-F.col("left")).alias("at"), F.col("x2").cast("double").alias("x"), F.col("y2").cast("double").alias("y"))))).alias("_p"),
    )
    points = F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return out.select(*KEYS, "ring", (F.col("area") > 0).alias("outer"), "perimeter", "area", F.concat(points, F.slice(points, 1, 1)).alias("geom"))


def measures(found: DataFrame) -> DataFrame:
    """Perimeter and area of each component from its rings."""
    return found.groupBy(*KEYS).agg(F.sum("perimeter").alias("perimeter"), F.sum("area").alias("area"))


def polygons(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(raster_id, label, part, area, rings): polygons of each component from its rings, the outer one first.

    A ring runs along pixels that are connected by their sides, so the outer ring and the holes of one
    polygon have the same label of four neighbours (part) at the pixel that names them; no ring is compared
    with another. A component whose pieces touch at corners has several polygons."""
    from gridloom.operators.components import label

    four = label(labels.select("raster_id", "r", "c"), eight=False).withColumnRenamed("label", "part")
    place = F.floor(F.col("ring") / 4)
    named = found.withColumns({"r": F.floor(place / (1 << 22)).cast("int"), "c": (place % (1 << 22)).cast("int")}).join(four, ["raster_id", "r", "c"])
    own = named.groupBy(*KEYS, "part").agg(F.sum("area").alias("area"), F.array_sort(F.collect_list(F.struct((~F.col("outer")).alias("hole"), "ring", "geom"))).alias("_r"))
    return own.select(*KEYS, "part", "area", F.transform("_r", lambda x: x["geom"]).alias("rings"))
