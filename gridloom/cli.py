"""Command line: ``python -m gridloom.cli inspect|extract|change ...``.

inspect FILES            what is known of each TIFF scene
extract FILES OUT        qualifying road segments of the scenes, as GeoJSON lines and a table
change BEFORE AFTER OUT  layers of new, removed and all changes between two road tables (Parquet)
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scene
from gridloom.plans import change, evidence, extract
from gridloom.session import local_session, ship, written
from gridloom.sources import files, raster


def catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scenes of the TIFF files of a folder with ids of their own, and their blocks."""
    scenes = raster.scenes(spark, path).withColumns({"raster_id": F.abs(F.xxhash64("path")), "projected": F.col("srid").isNull() | (F.col("srid") != 4326)})
    return written(scenes, "scenes"), raster.blocks(spark, path)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    scenes, _ = catalog(spark, path)
    return scene.report(scenes).join(scenes.select("raster_id", "path"), "raster_id").select("path", "text")


def extracted(spark: SparkSession, path: str, out: str, gsd: float | None = None, t: float = 0.35) -> DataFrame:
    """Roads of the scenes by the evidence predictor: segments that qualify, as a table and as GeoJSON lines.

    Every scene has its own ground distance, or all have the one that is given; 1 where none is known."""
    scenes, found = catalog(spark, path)
    distances = scene.described(scenes).select("raster_id", F.lit(gsd).alias("gsd") if gsd else F.coalesce("gsd", F.lit(1.0)).alias("gsd"))
    pixels = raster.pixels(found).join(scenes.select("path", "raster_id"), "path")
    bands = pixels.groupBy("raster_id", "r", "c").agg(*(F.coalesce(F.max(F.when(F.col("ch") == k, F.col("v"))), F.max(F.when(F.col("ch") == 0, F.col("v")))).alias(b) for k, b in enumerate(("red", "green", "blue"))))
    prob = written(evidence.probability(written(bands, "bands"), scenes), "probability")
    m = written(extract.clean_mask(prob, scenes, t), "mask")
    roads = written(extract.lines(extract.road_segments(m, prob, scenes, distances).filter("qualifies"), scenes), "roads")
    roads.write.mode("overwrite").parquet(f"{out}/roads")
    files.features(roads, ["road_id", "length_m", "mean_width_m", "confidence"]).write.mode("overwrite").text(f"{out}/roads_geojson")
    return roads


def changed(spark: SparkSession, before: str, after: str, out: str, buffer: float = 3.5, least: float = 20.0) -> list[str]:
    found = written(change.compare(spark.read.parquet(before), spark.read.parquet(after), buffer, least), "changes")
    return files.write_changes(found, out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("inspect")
    one.add_argument("files")
    two = sub.add_parser("extract")
    two.add_argument("files")
    two.add_argument("out")
    two.add_argument("--gsd", type=float)
    two.add_argument("--threshold", type=float, default=0.35)
    three = sub.add_parser("change")
    for name in ("before", "after", "out"):
        three.add_argument(name)
    three.add_argument("--buffer", type=float, default=3.5)
    three.add_argument("--least", type=float, default=20.0)
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    if args.command == "inspect":
        for r in inspect(spark, args.files).toLocalIterator():
            print(r["path"], r["text"], sep="\n")
    elif args.command == "extract":
        print(extracted(spark, args.files, args.out, args.gsd, args.threshold).count(), "roads")
    else:
        print("layers:", ", ".join(changed(spark, args.before, args.after, args.out, args.buffer, args.least)) or "none")


if __name__ == "__main__":
    main()
