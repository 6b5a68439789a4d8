"""Rasters, catalogs, road networks and lists derived from the star-schema tables.

They stand in for scenes where only those tables are at hand; the same rows can be had in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dense raster: a row for each vector, a column for each component."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "v"))
    return e.select(F.lit(0).cast("long").alias("raster_id"), F.col("vec_id").cast("int").alias("r"), "c", F.col("v").cast("double").alias("v"))


def event_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse raster for each event type: days by hours, mean value."""
    e = table(spark, sf_dir, "events")
    kinds = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
    number = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(n)) for k, n in kinds.items()), F.lit(5))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(number.cast("long").alias("raster_id"), day.cast("int").alias("r"), F.hour("ts").cast("int").alias("c")).agg(F.avg("value").alias("v"))


def scene_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene size for each part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("raster_id"),
        (F.lit(256) + F.col("p_partkey") % 1800).cast("int").alias("width"),
        (F.lit(256) + (F.col("p_size") * 37) % 1300).cast("int").alias("height"),
    )


def affine_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and position of a scene for each supplier: every third in degrees, the others in metres."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    projected = k % 3 != 0
    lat = (k % 60).cast("double")
    size = F.when(projected, F.lit(0.1) + (k % 40) / F.lit(10.0)).otherwise((F.lit(1) + k % 9) / F.lit(1000000.0))
    return s.select(
        k.alias("raster_id"),
        F.lit(1024).alias("width"),
        F.lit(768).alias("height"),
        (F.lit(1) + k % 4).cast("int").alias("count"),
        projected.alias("projected"),
        size.alias("t_a"), F.lit(0.0).alias("t_b"), F.when(projected, F.lit(500000.0)).otherwise(F.lit(72.0)).alias("t_c"),
        F.lit(0.0).alias("t_d"), (-size).alias("t_e"), F.when(projected, F.lit(2500000.0)).otherwise(lat).alias("t_f"),
        F.when(projected, F.lit(32643)).otherwise(F.lit(4326)).alias("srid"),
    )


def roads(spark: SparkSession, sf_dir: str, snapshot: str) -> DataFrame:
    """A road of two straight pieces for every order; ``before`` has those of status F and P, ``after`` of
    O and P. Fifteen orders share a band ten metres high, so the network spreads as the table grows."""
    o = table(spark, sf_dir, "orders")
    o = o.filter(F.col("o_orderstatus").isin("F" if snapshot == "before" else "O", "P"))
    x0 = (F.col("o_custkey") % 1000).cast("double")
    y0 = (F.lit(10) * F.floor(F.col("o_orderkey") / 15)).cast("double")
    x1 = x0 + 10 + (F.floor("o_totalprice") % 50).cast("double")
    y1 = y0 + (F.col("o_custkey") % 7).cast("double")
    x2 = x1 + 10 + (F.col("o_custkey") % 41).cast("double")
    y2 = y0 + (F.col("o_orderkey") % 5).cast("double")

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return o.select(
        F.col("o_orderkey").alias("road_id"),
        (F.lit(4) + F.col("o_custkey") % 9).cast("double").alias("mean_width_m"),
        F.lit(0.9).alias("confidence"),
        F.array(point(x0, y0), point(x1, y1), point(x2, y2)).alias("geom"),
        F.lit(32643).alias("srid"),
    )


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of an image for each document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("DF/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of videos: conversations and their turns."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("frame_idx"), F.length("text").alias("size"))
