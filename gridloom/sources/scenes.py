"""Synthetic scenes: soil and vegetation with roads, at two times; a road is added between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Road:
    points: tuple[tuple[float, float], ...]
    width: float
    colour: tuple[int, int, int]


#: Size, ground distance, origin and system of the scenes, their roads (x, y, width in pixels) and the ranges of the
#: ground's colours (fixed values).
SIZE, GSD, ORIGIN, SRID = 1024, 0.30, (500000.0, 2500000.0), 32643
ROADS = (
    Road(((200, 1024), (1024, 200)), 50, (70, 70, 70)),
    Road(((50, 100), (150, 180), (100, 300), (200, 450)), 6, (140, 120, 90)),
    Road(((100, 0), (250, 300), (450, 600), (800, 900), (1024, 950)), 20, (85, 85, 85)),
    Road(((450, 600), (0, 700)), 20, (85, 85, 85)),
)
NEW_ROAD = Road(((250, 300), (800, 200)), 20, (85, 85, 85))
GROUND = ((60, 90), (110, 150), (50, 80))


def _distance(points) -> Column:
    """Distance of pixel (c, r) from a line of points."""
    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    found = []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        dx, dy = bx - ax, by - ay
        t = F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / float(dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        found.append(F.hypot(x - ax - t * dx, y - ay - t * dy))
    return F.least(*found) if len(found) > 1 else found[0]


def scene(spark: SparkSession, later: bool = False, size: int = SIZE, seed: int = 42) -> DataFrame:
    """(raster_id, r, c, red, green, blue) in 0..255. Noise comes from hashes of the place, so both times share it."""
    pixels = spark.range(size * size).select(F.lit(int(later)).cast("long").alias("raster_id"), F.floor(F.col("id") / size).cast("int").alias("r"), (F.col("id") % size).cast("int").alias("c"))

    def noise(k: int) -> Column:
        return F.pmod(F.xxhash64("r", "c", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)

    bands = {}
    for k, (name, (low, high)) in enumerate(zip(("red", "green", "blue"), GROUND, strict=True)):
        # a sum of uniform numbers is close to a normal one of deviation 10
        bell = (noise(10 * k) + noise(10 * k + 1) + noise(10 * k + 2) - 1.5) * 20.0
        value = F.least(F.greatest(F.floor(low + noise(10 * k + 3) * (high - low)) + F.floor(bell), F.lit(0)), F.lit(255))
        for road in (*ROADS, *((NEW_ROAD,) if later else ())):
            value = F.when(F.col(f"_d{_key(road)}") <= road.width / 2, F.lit(road.colour[k])).otherwise(value)
        bands[name] = value.cast("int")
    away = pixels.withColumns({f"_d{_key(road)}": _distance(road.points) for road in (*ROADS, NEW_ROAD)})
    return away.select("raster_id", "r", "c", *(v.alias(n) for n, v in bands.items()))


def _key(road: Road) -> int:
    return (*ROADS, NEW_ROAD).index(road)


def catalog(spark: SparkSession, size: int = SIZE) -> DataFrame:
    """The catalog rows of both scenes."""
    return spark.range(2).select(
        F.col("id").alias("raster_id"), F.lit(size).alias("width"), F.lit(size).alias("height"), F.lit(3).alias("count"), F.lit(True).alias("projected"), F.lit(SRID).alias("srid"),
        F.lit(GSD).alias("t_a"), F.lit(0.0).alias("t_b"), F.lit(ORIGIN[0]).alias("t_c"), F.lit(0.0).alias("t_d"), F.lit(-GSD).alias("t_e"), F.lit(ORIGIN[1]).alias("t_f"),
    )
