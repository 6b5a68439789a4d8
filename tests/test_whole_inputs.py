"""Queries on their whole input, against brute force."""

import math

from gridloom import registry
from gridloom.plans import change
from gridloom.sources import virtual


def uncovered_by_steps(road, others, buffer, steps):
    """Length of a road farther than buffer from all others, by points along its pieces."""
    free = 0.0
    for (ax, ay), (bx, by) in zip(road, road[1:], strict=False):
        for i in range(steps):
            t = (i + 0.5) / steps
            x, y = ax + t * (bx - ax), ay + t * (by - ay)
            for (cx, cy), (dx, dy) in others:
                u = ((x - cx) * (dx - cx) + (y - cy) * (dy - cy)) / ((dx - cx) ** 2 + (dy - cy) ** 2)
                u = min(max(u, 0), 1)
                if math.hypot(x - cx - u * (dx - cx), y - cy - u * (dy - cy)) <= buffer:
                    break
            else:
                free += math.hypot(bx - ax, by - ay) / steps
    return free


def line(r):
    return [(p["x"], p["y"]) for p in r["geom"]]


def test_every_order_is_a_road(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    for snapshot, states in (("before", ("F", "P")), ("after", ("O", "P"))):
        want = {r[0] for r in orders.filter(orders["o_orderstatus"].isin(*states)).select("o_orderkey").collect()}
        assert {r["road_id"] for r in virtual.roads(spark, sf, snapshot).select("road_id").collect()} == want
        if snapshot == "after":
            assert {r["road_id"] for r in registry.queries()["road_lengths"](spark, sf).collect()} == want
            assert registry.queries()["road_features"](spark, sf).count() == len(want)


def test_parts_of_all_roads_by_brute_force(spark, sf):
    before, after = virtual.roads(spark, sf, "before"), virtual.roads(spark, sf, "after")
    some = after.filter("road_id < 60")
    left, parts = {}, 0
    for r in change.uncovered(some, before, 3.5).collect():
        left[r["road_id"]] = left.get(r["road_id"], 0.0) + r["length_m"]
        parts += len(r["geom"]) == 3
    lines = [line(r) for r in before.filter("road_id < 100").collect()]
    others = [pair for x in lines for pair in zip(x, x[1:], strict=False)]
    for r in some.collect():
        road = line(r)
        assert abs(left.get(r["road_id"], 0.0) - uncovered_by_steps(road, others, 3.5, 200)) <= 1.0
    assert parts  # some go on over the bend


def test_long_slanting_segments_meet_in_the_cells_they_cross(spark):
    def roads(*lines):
        return spark.createDataFrame([(i, 6.0, 0.9, [{"x": float(x), "y": float(y)} for x, y in p], 32643) for i, p in enumerate(lines)], "road_id long, mean_width_m double, confidence double, geom array<struct<x:double,y:double>>, srid int")

    a = roads([(0, 0), (10000, 10000)], [(-500, 300), (-500, 900)])
    b = roads([(2, 0), (10002, 10000)], [(5000, 5050), (9000, 9050)], [(-502, 0), (-498, 1000)])
    assert change.uncovered(a, b, 3.5).count() == 0
    s = change.segments(a.filter("road_id = 0"))
    assert change._cells(s, 0.0).count() < 4 * 10000 / change.CELL


def test_before_is_brought_to_the_system_of_after(spark, sf):
    from pyspark.sql import functions as F

    from gridloom.functions.geometry import reproject

    before, after = virtual.roads(spark, sf, "before").limit(40), virtual.roads(spark, sf, "after").limit(40)
    shifted = before.withColumn("geom", F.transform("geom", lambda p: F.struct((p["x"] + 500000).alias("x"), (p["y"] + 2500000).alias("y"))))
    other = after.withColumn("geom", F.transform("geom", lambda p: F.struct((p["x"] + 500000).alias("x"), (p["y"] + 2500000).alias("y"))))
    degrees = shifted.withColumn("geom", reproject(F.col("geom"), F.col("srid"), F.lit(4326))).withColumn("srid", F.lit(4326))
    rows = lambda df: sorted((r["change_type"], r["source_id"], r["part"], round(r["length_m"], 1)) for r in df.collect())
    assert rows(change.compare(degrees, other)) == rows(change.compare(shifted, other))
