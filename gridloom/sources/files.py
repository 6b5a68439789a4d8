"""Images, lists and features as files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import to_wgs84
from gridloom.sources import tiff


def images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, size and bytes of the image files of a folder; bytes are only read where they are asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"), "content")


def paths_under(found: DataFrame, root: str) -> DataFrame:
    """Paths relative to a root."""
    return found.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("path"))


def write_list(paths: DataFrame, folder: str) -> None:
    """One path a line, sorted over all files of the list."""
    paths.select(F.col("path").alias("value")).orderBy("value").write.text(folder)


def features(roads: DataFrame, properties: list[str], geographic: bool = True) -> DataFrame:
    """A GeoJSON feature of each road (geom, srid) as a line of text; positions in degrees unless told otherwise."""
    geom = to_wgs84(F.col("geom"), F.col("srid")) if geographic else F.col("geom")
    shape = F.struct(F.lit("LineString").alias("type"), F.transform(geom, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    kind = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))
    return roads.select(F.to_json(kind).alias("value"))


def write_features(roads: DataFrame, properties: list[str], folder: str) -> None:
    """Newline-delimited GeoJSON, one file a task."""
    features(roads, properties).write.text(folder)


def write_changes(changes: DataFrame, folder: str) -> list[str]:
    """Layers of new, removed and all changes, each only where there are rows."""
    written = []
    for name, kind in (("new_roads", "NEW_ROAD"), ("removed_roads", "REMOVED_ROAD"), ("all_changes", None)):
        some = changes if kind is None else changes.filter(F.col("change_type") == kind)
        if not some.isEmpty():
            some.write.parquet(f"{folder}/{name}")
            written.append(name)
    return written


def write_raster(raster: DataFrame, folder: str) -> None:
    """Pixels by raster; rows in order, so that windows of a raster skip row groups."""
    raster.repartition("raster_id", F.floor(F.col("r") / 512)).sortWithinPartitions("raster_id", "r", "c").write.partitionBy("raster_id").parquet(folder)


def union_of_lists(*lists: DataFrame) -> DataFrame:
    """Paths of several folders as one list, each path once."""
    out = lists[0].select("path")
    for other in lists[1:]:
        out = out.unionByName(other.select("path"))
    return out.distinct()


def feature_union(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines (road_id, mean_width_m, geom) and outlines (label, geom) as rows of one layer; outlines have no width."""
    a = lines.select(F.lit("centerline").alias("feature_type"), F.col("road_id").cast("long").alias("source_id"), F.col("mean_width_m").cast("double").alias("width_m"), "geom")
    b = regions.select(F.lit("corridor").alias("feature_type"), F.col("label").cast("long").alias("source_id"), F.lit(None).cast("double").alias("width_m"), "geom")
    return a.unionByName(b)


def polygon_features(polygons: DataFrame, scenes: DataFrame) -> DataFrame:
    """A GeoJSON Polygon, or MultiPolygon where there are several, for each component of scenes that have a system,
    in the scene's own system; outer rings run against the clock and holes with it. polygons: of operators.polygon;
    no rows where nothing is placed or found."""
    placed = polygons.join(scenes.filter("srid is not null").select("raster_id", *(f"t_{k}" for k in "abcdef")), "raster_id")
    turned = F.col("t_a") * F.col("t_e") - F.col("t_b") * F.col("t_d") < 0

    def at(ring: Column) -> Column:
        points = F.transform(ring, lambda p: F.array(F.col("t_a") * p["x"] + F.col("t_b") * p["y"] + F.col("t_c"), F.col("t_d") * p["x"] + F.col("t_e") * p["y"] + F.col("t_f")))
        return F.when(turned, F.reverse(points)).otherwise(points)

    own = placed.withColumn("_xy", F.transform("rings", at)).groupBy("raster_id", "label").agg(F.array_sort(F.collect_list(F.struct("part", "_xy"))).alias("_p"))

    def feature(kind: str, coordinates: Column) -> Column:
        shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("label", F.lit("corridor").alias("feature_type")).alias("properties"), shape.alias("geometry")))

    one, many = feature("Polygon", F.col("_p")[0]["_xy"]), feature("MultiPolygon", F.transform("_p", lambda p: p["_xy"]))
    return own.select("raster_id", "label", F.when(F.size("_p") == 1, one).otherwise(many).alias("value"))


def pixels_of(found: DataFrame) -> DataFrame:
    """Pixels (path, r, c, ch, v) of PNG and TIFF files (path, content); a gray image has one channel.

    A file is a row; :mod:`gridloom.sources.raster` reads TIFF files block by block. Files that cannot be
    read are an error that names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    a = decoded(content)
                except Exception as e:
                    raise ValueError(f"cannot read {path}: {e}") from e
                rows = max(1, 200_000 // max(1, a.shape[1] * a.shape[2]))
                for r0 in range(0, a.shape[0], rows):
                    some = a[r0 : r0 + rows]
                    r, c, ch = (x.ravel() for x in np.indices(some.shape, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(r)), pa.array(r + r0), pa.array(c), pa.array(ch), pa.array(some.ravel().astype(float))], ["path", "r", "c", "ch", "v"])

    return found.select("path", "content").mapInArrow(run, "path string, r int, c int, ch int, v double")


def decoded(data: bytes) -> np.ndarray:
    """Rows, columns and channels of a PNG or TIFF."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return _tiff(data)
    raise ValueError("neither PNG nor TIFF")


def _png(data: bytes) -> np.ndarray:
    at, packed, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, at = data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if interlaced or bits not in (8, 16):
        raise ValueError("interlaced, or less than 8 bits")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, raw = channels * bits // 8, np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, -1)
    out, above = np.zeros((h, raw.shape[1] - 1), np.uint8), np.zeros(raw.shape[1] - 1, np.uint8)
    for i in range(h):
        out[i] = above = _unfiltered(raw[i, 0], raw[i, 1:], above, step)
    a = (out.view(">u2") if bits == 16 else out).reshape(h, w, channels)
    return palette[a[:, :, 0]] if colour == 3 else a


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG from what its filter left."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line), np.uint8)
    for i in range(len(line)):
        left, up, corner = (int(out[i - step]), int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        out[i] = (int(line[i]) + guess) & 255
    return out


def _tiff(data: bytes) -> np.ndarray:
    image = tiff.Image(lambda at, n: data[at : at + n])
    out = np.zeros((image.height, image.width, image.bands), image.kind.newbyteorder("="))
    for b in image.blocks():
        a = image.decode(b, data[b.at : b.at + b.size])
        k = max(0, b.band)
        out[b.row : b.row + b.rows, b.col : b.col + b.cols, k : k + a.shape[2]] = a
    return out


def scenes_of(found: DataFrame) -> DataFrame:
    """Catalog rows of TIFF files (path, content): sizes, bands, and the transform and system where they are given."""
    names = ["path", "width", "height", "count", "srid", "t_a", "t_b", "t_c", "t_d", "t_e", "t_f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                image = tiff.Image(lambda at, n, content=content: content[at : at + n])
                rows.append((path, image.width, image.height, image.bands, image.srid(), *(image.transform() or (None,) * 6)))
            kinds = [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 11, kinds, strict=True)], names)

    return found.select("path", "content").mapInArrow(run, "path string, width int, height int, count int, srid int, " + ", ".join(f"t_{k} double" for k in "abcdef"))
