"""Rasters in files as a Spark data source: ``spark.read.format("raster")`` and ``df.write.format("raster")``.

Reading gives a row for each strip or tile of a file (:data:`BLOCKS`). Filters on path and on the
bounds of blocks are pushed down: what they rule out is no partition and is not fetched, so a window
of a large scene costs the blocks that it touches. Up to ``HEADERS`` files are planned by block on the
driver, which fetches their directories only; beyond, a partition is a run of files whose tasks do so.

Writing takes rows of the same kind and makes a file for each path. Rows of a path meet in one task
(:func:`write`), tasks write under a hidden folder, and the driver renames whole files into place once
all tasks are done; a task or job that fails leaves nothing that a reader sees. A large scene is
written as several files, one for each band of rows, each with its own place on the ground.

Files are reached through pyarrow's file systems, so a path may be local or in a store it knows.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridloom.sources import tiff

BLOCKS = "path string, row_off int, col_off int, row_end int, col_end int, height int, width int, bands int, first_band int, kind string, data binary"
HEADERS, RUN_BYTES, RUN_FILES = 1000, 8 << 20, 100
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_BOUNDS = ("row_off", "col_off", "row_end", "col_end")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" not in path:
        path = "file://" + (path.removeprefix("file:") if path.startswith("file:/") else os.path.abspath(path))
    return fs.FileSystem.from_uri(path)


def files_of(path: str, pattern: str) -> list[str]:
    """Paths of a file, or of the files of a folder that match; hidden ones are left out."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File)
    return [posixpath.join(path, n) for n in names if fnmatch(n.lower(), pattern.lower()) and n[0] not in "._"]


class _Open:
    """A file of which parts are fetched."""

    def __init__(self, path: str):
        system, at = located(path)
        self.file = system.open_input_file(at)

    def __call__(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)


@dataclass
class Wanted:
    """Bounds that filters leave: name of a column to its least and greatest value."""

    least: dict[str, int] = field(default_factory=dict)
    most: dict[str, int] = field(default_factory=dict)
    path: str | None = None

    def add(self, f: Filter) -> bool:
        """Whether the filter is understood; it then holds for all that is read."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
        if name == "path" and isinstance(f, EqualTo) and self.path in (None, f.value):
            self.path = f.value
            return True
        if name not in _BOUNDS or not isinstance(getattr(f, "value", None), int):
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.least[name] = max(self.least.get(name, f.value), f.value + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.most[name] = min(self.most.get(name, f.value), f.value - isinstance(f, LessThan))
        return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))

    def holds(self, b: tiff.Block) -> bool:
        have = {"row_off": b.row, "col_off": b.col, "row_end": b.row + b.rows, "col_end": b.col + b.cols}
        return all(have[k] >= v for k, v in self.least.items()) and all(have[k] <= v for k, v in self.most.items())


@dataclass
class _Part(InputPartition):
    files: list[tuple[str, list[tiff.Block] | None]]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*.tif*"))
        self.headers = int(options.get("headers", HEADERS))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.add(f):
                yield f

    def partitions(self) -> list[_Part]:
        paths = [p for p in files_of(self.path, self.pattern) if self.wanted.path in (None, p)]
        if len(paths) > self.headers:
            return [_Part([(p, None) for p in paths[i : i + RUN_FILES]]) for i in range(0, len(paths), RUN_FILES)]
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(lambda p: list(filter(self.wanted.holds, tiff.Image(_Open(p)).blocks())), paths))
        parts: list[_Part] = []
        for path, blocks in zip(paths, found, strict=True):
            run: list[tiff.Block] = []
            for b in blocks:
                if run and sum(x.size for x in run) + b.size > RUN_BYTES:
                    parts.append(_Part([(path, run)]))
                    run = []
                run.append(b)
            if run:
                parts.append(_Part([(path, run)]))
        # a scan has a partition at least
        return parts or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for path, blocks in partition.files:
            get = _Open(path)
            try:
                image = tiff.Image(get)
                for b in filter(self.wanted.holds, image.blocks()) if blocks is None else blocks:
                    a = image.decode(b, get(b.at, b.size))
                    row = [path, b.row, b.col, b.row + b.rows, b.col + b.cols, image.height, image.width, a.shape[2], max(0, b.band), a.dtype.str[1:], a.tobytes()]
                    kinds = [pa.string(), *[pa.int32()] * 8, pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], _NAMES)
            except Exception as e:
                raise ValueError(f"cannot read {path}: {e}") from e


@dataclass
class _Done(WriterCommitMessage):
    files: list[str]


class RasterWriter(DataSourceArrowWriter):
    """Writes a file for each path of its rows, TIFF or PNG by its name."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.tile = int(options.get("tile", "0")) or None
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        from pyspark import TaskContext

        system, root = located(self.path)
        folder = posixpath.join(root, self.job, f"{TaskContext.get().taskAttemptId()}")
        system.create_dir(folder, recursive=True)
        done: list[str] = []
        image, now, about = None, None, None

        def close() -> None:
            if now is not None:
                data = tiff.png(image) if now.lower().endswith(".png") else tiff.encoded(image, *about, tile=self.tile)
                with system.open_output_stream(posixpath.join(folder, now)) as out:
                    out.write(data)
                done.append(posixpath.join(folder, now))

        for batch in iterator:
            for r in batch.to_pylist():
                if r["path"] != now:
                    close()
                    now = r["path"]
                    if "/" in now or now in {posixpath.basename(d) for d in done}:
                        raise ValueError(f"rows of {now} are apart, or its name is not one of a file")
                    image = np.zeros((r["height"], r["width"], r["bands"]), r["kind"])
                    place = tuple(r[f"t_{k}"] for k in "abcdef") if r.get("t_a") is not None else None
                    about = place, r.get("srid"), r.get("nodata")
                part = np.frombuffer(r["data"], r["kind"]).reshape(r["row_end"] - r["row_off"], r["col_end"] - r["col_off"], -1)
                k = r.get("first_band") or 0
                image[r["row_off"] : r["row_end"], r["col_off"] : r["col_end"], k : k + part.shape[2]] = part
        close()
        return _Done(done)

    def commit(self, messages: list[_Done | None]) -> None:
        system, root = located(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [posixpath.basename(f) for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of a path were in several tasks; write them with gridloom.sources.raster.write")
        old = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name not in names] if self.overwrite else []
        for f, name in zip(files, names, strict=True):
            system.move(f, posixpath.join(root, name))
        for f in old:
            system.delete_file(f)
        system.delete_dir(posixpath.join(root, self.job)) if system.get_file_info(posixpath.join(root, self.job)).type == fs.FileType.Directory else None

    def abort(self, messages: list[_Done | None]) -> None:
        system, root = located(self.path)
        if system.get_file_info(posixpath.join(root, self.job)).type == fs.FileType.Directory:
            system.delete_dir(posixpath.join(root, self.job))


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def blocks(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, pattern: str = "*.tif*") -> DataFrame:
    """Blocks of the files of a path; window: first column and row, width and height of what is wanted."""
    register(spark)
    found = spark.read.format("raster").option("pathGlobFilter", pattern).load(path)
    if window is not None:
        c, r, w, h = window
        found = found.filter((F.col("row_off") < r + h) & (F.col("row_end") > r) & (F.col("col_off") < c + w) & (F.col("col_end") > c))
    return found


def scenes(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """Catalog rows of TIFF files: path, sizes, bands, and transform and system where they are given; directories only are fetched."""
    names = ["path", "width", "height", "count", "srid", *(f"t_{k}" for k in "abcdef")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column("path").to_pylist():
                image = tiff.Image(_Open(p))
                rows.append((p, image.width, image.height, image.bands, image.srid(), *(image.transform() or (None,) * 6)))
            kinds = [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 11, kinds, strict=True)], names)

    paths = spark.createDataFrame([(p,) for p in files_of(path, pattern)], "path string").repartition("path")
    return paths.mapInArrow(run, "path string, width int, height int, count int, srid int, " + ", ".join(f"t_{k} double" for k in "abcdef"))


def pixels(found: DataFrame, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, r, c, ch, v) of blocks, within a window if one is given."""
    c0, r0, w, h = window or (0, 0, 1 << 30, 1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a = np.frombuffer(x["data"], x["kind"]).reshape(x["row_end"] - x["row_off"], x["col_end"] - x["col_off"], -1)
                top, left = max(0, r0 - x["row_off"]), max(0, c0 - x["col_off"])
                a = a[top : r0 + h - x["row_off"], left : c0 + w - x["col_off"]]
                step = max(1, 200_000 // max(1, a.shape[1] * a.shape[2]))
                for low in range(0, len(a), step):
                    some = a[low : low + step]
                    r, c, ch = (i.ravel() for i in np.indices(some.shape, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["path"]] * len(r)), pa.array(r + np.int32(low + top + x["row_off"])), pa.array(c + np.int32(left + x["col_off"])), pa.array(ch + np.int32(x["first_band"])), pa.array(some.ravel().astype(float))],
                        ["path", "r", "c", "ch", "v"],
                    )

    return found.mapInArrow(run, "path string, r int, c int, ch int, v double")


def write(rows: DataFrame, folder: str, mode: str = "append", tile: int | None = None) -> None:
    """Rows of BLOCKS (and t_a to t_f, srid, nodata where they are known) as files; every path is written by one task."""
    register(rows.sparkSession)
    dealt = rows.repartition("path").sortWithinPartitions("path", "row_off", "col_off")
    out = dealt.write.format("raster").mode(mode)
    (out.option("tile", str(tile)) if tile else out).save(folder)


def of_chunks(chunks, names: DataFrame, rows_a_file: int = 1 << 30, extension: str = "tif") -> DataFrame:
    """Rows for :func:`write` of a table of tiles. names: raster_id and name (and t_a to t_f, srid, nodata). A raster of more rows than
    ``rows_a_file`` (a multiple of the tile's side) becomes several files, numbered by their first row."""
    form, each = chunks.form, max(1, rows_a_file // chunks.form.tile) * chunks.form.tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.ascontiguousarray(form.array(d, *p).transpose(1, 2, 0)).tobytes() for d, *p in zip(*(batch.column(n).to_pylist() for n in ("data", "tr", "tc", "height", "width")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("raster_id", "tr", "tc", "height", "width")] + [pa.array(data, pa.binary())], ["raster_id", "tr", "tc", "height", "width", "data"])

    whole = chunks.table.select("raster_id", "tr", "tc", "height", "width", "data").mapInArrow(run, "raster_id long, tr int, tc int, height int, width int, data binary").join(names, "raster_id")
    r, c = F.col("tr") * form.tile, F.col("tc") * form.tile
    first = (F.floor(r / each) * each).cast("int")
    placed = [n for n in names.columns if n not in ("raster_id", "name", "t_c", "t_f")]
    shifted = [(F.col("t_c") + F.col("t_b") * first).alias("t_c"), (F.col("t_f") + F.col("t_e") * first).alias("t_f")] if "t_c" in names.columns else []
    name = F.when(F.col("height") > each, F.concat("name", F.lit("_r"), first.cast("string"))).otherwise(F.col("name"))
    return whole.select(
        F.concat(name, F.lit("." + extension)).alias("path"), (r - first).cast("int").alias("row_off"), c.cast("int").alias("col_off"),
        (F.least(r + form.tile, F.col("height")) - first).cast("int").alias("row_end"), F.least(c + form.tile, F.col("width")).cast("int").alias("col_end"),
        F.least(F.lit(each), F.col("height") - first).cast("int").alias("height"), "width", F.lit(form.bands).alias("bands"), F.lit(0).alias("first_band"), F.lit(form.kind).alias("kind"), "data", *placed, *shifted,
    )
