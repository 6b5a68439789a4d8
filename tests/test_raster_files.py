"""The raster data source: blocks by window, every layout of a TIFF, writing in tasks and all or nothing."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

from gridloom.operators import chunks
from gridloom.sources import files, raster, tiff

A = (np.arange(70 * 90 * 3).reshape(70, 90, 3) * 7 % 251).astype(np.uint8)
PLACE = (0.5, 0.0, 500000.0, 0.0, -0.5, 2500000.0)


def lzw(data):
    """Codes as a writer of the format makes them."""
    bits, n, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8
            bits &= (1 << n) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    size = 258
    for x in data:
        if word + bytes([x]) in table:
            word += bytes([x])
            continue
        put(table[word], width)
        table[word + bytes([x])] = size
        size += 1
        if size + 1 > 1 << width:
            width += 1
        if size >= 4094:
            put(256, width)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([x])
    put(table[word], width)
    put(257, width)
    put(0, 7)
    return bytes(out)


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + bytes([257 - 50, 9])


def built(parts, tags, order="<", big=False):
    """A file of given blocks; tags: number to (type, values)."""
    at, places = 16 if big else 8, []
    for p in parts:
        places.append(at)
        at += len(p)
    tags = {k: v for k, v in tags.items()}
    key = (324, 325) if 322 in tags else (273, 279)
    tags[key[0]], tags[key[1]] = ("I", places), ("I", [len(p) for p in parts])
    slot = "Q" if big else "I"
    codes = {"H": 3, "I": 4, "d": 12}
    entries, more, free = b"", b"", at + (8 if big else 2) + len(tags) * (20 if big else 12) + (8 if big else 4)
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = struct.pack(order + kind * len(values), *values)
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, codes[kind], len(values))
        if len(raw) <= (8 if big else 4):
            entries += raw.ljust(8 if big else 4, b"\0")
        else:
            entries += struct.pack(order + slot, free + len(more))
            more += raw
    mark = b"II" if order == "<" else b"MM"
    head = mark + struct.pack(order + "HHHQ", 43, 8, 0, at) if big else mark + struct.pack(order + "HI", 42, at)
    return head + b"".join(parts) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * (8 if big else 4) + more


def layout(name):
    h, w = A.shape[:2]
    base = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8] * 3), 259: ("H", [1]), 277: ("H", [3]), 278: ("I", [32]), 284: ("H", [1])}
    strips = [A[r : r + 32] for r in range(0, h, 32)]
    plain = [s.tobytes() for s in strips]
    if name == "plain":
        return built(plain, base), A
    if name == "big endian, 16 bits":
        b = (A.astype("u2") * 200).astype(">u2")
        return built([b[r : r + 32].tobytes() for r in range(0, h, 32)], base | {258: ("H", [16] * 3)}, ">"), b
    if name == "big":
        return built(plain, base, big=True), A
    if name == "lzw":
        return built([lzw(p) for p in plain], base | {259: ("H", [5])}), A
    if name == "packbits":
        return built([packbits(p) for p in plain], base | {259: ("H", [32773])}), A
    if name == "deflate, predicted":
        return built([zlib.compress(np.diff(s, axis=1, prepend=np.zeros((len(s), 1, 3), np.uint8)).tobytes()) for s in strips], base | {259: ("H", [8]), 317: ("H", [2])}), A
    if name == "bands apart":
        return built([A[r : r + 32, :, k].tobytes() for k in range(3) for r in range(0, h, 32)], base | {284: ("H", [2])}), A
    if name == "tiles":
        full = np.zeros((96, 96, 3), np.uint8)
        full[:h, :w] = A
        tiles = [full[r : r + 32, c : c + 32].tobytes() for r in range(0, 96, 32) for c in range(0, 96, 32)]
        return built([zlib.compress(t) for t in tiles], {k: v for k, v in base.items() if k != 278} | {259: ("H", [8]), 322: ("I", [32]), 323: ("I", [32])}), A
    f = (A[:, :, :1] * 0.37 - 20).astype("<f4")
    rows = []
    for r in range(0, h, 32):
        part = f[r : r + 32, :, 0]
        by = part.astype(">f4").view(np.uint8).reshape(len(part), w, 4).transpose(0, 2, 1).reshape(len(part), -1)
        rows.append(zlib.compress(np.diff(by, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).tobytes()))
    return built(rows, base | {258: ("H", [32]), 277: ("H", [1]), 339: ("H", [3]), 259: ("H", [8]), 317: ("H", [3])}), f


LAYOUTS = ["plain", "big endian, 16 bits", "big", "lzw", "packbits", "deflate, predicted", "bands apart", "tiles", "float, predicted"]


def whole(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["r"], r["c"], r["ch"]] = r["v"]
    return out


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    data, want = layout(name)
    image = tiff.Image(lambda at, n: data[at : at + n])
    out = np.zeros(want.shape, want.dtype.newbyteorder("="))
    for b in image.blocks():
        a = image.decode(b, data[b.at : b.at + b.size])
        k = max(0, b.band)
        out[b.row : b.row + b.rows, b.col : b.col + b.cols, k : k + a.shape[2]] = a
    assert (out == want).all() and image.kind == want.dtype


def test_window_reads_its_blocks_only(spark, tmp_path):
    for name in ("tiles", "plain"):
        (tmp_path / f"{name}.tif").write_bytes(layout(name)[0])
    window = (40, 10, 20, 30)  # columns 40..59, rows 10..39
    got = raster.blocks(spark, str(tmp_path), window)
    assert "[" in got._jdf.queryExecution().executedPlan().toString()
    for name, blocks in (("tiles", 2), ("plain", 2)):
        own = got.filter(F.col("path").endswith(f"{name}.tif"))
        assert own.count() == blocks
        values = whole(raster.pixels(own, window), A.shape)
        assert (values[10:40, 40:60] == A[10:40, 40:60]).all() and np.isfinite(values).sum() == 30 * 20 * 3
    # what is not wanted is no partition, so it is not fetched
    reader = raster.RasterReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([LessThan(("row_off",), 40), GreaterThan(("row_end",), 10), LessThan(("col_off",), 60), GreaterThan(("col_end",), 40), EqualTo(("kind",), "u1")]))
    assert [type(f) for f in left] == [EqualTo]
    fetched = [b for p in reader.partitions() for _, blocks in p.files for b in blocks]
    assert len(fetched) == 4
    everything = raster.RasterReader({"path": str(tmp_path)}).partitions()
    assert sum(len(blocks) for p in everything for _, blocks in p.files) == 9 + 3
    # tasks that read directories themselves keep to the window as well
    lazy = raster.RasterReader({"path": str(tmp_path), "headers": "1"})
    list(lazy.pushFilters([LessThan(("row_off",), 10)]))
    assert sum(1 for p in lazy.partitions() for _ in lazy.read(p)) == 3 + 1


def test_same_pixels_as_whole_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(layout("bands apart")[0])
    assert (whole(raster.pixels(raster.blocks(spark, str(tmp_path))), A.shape) == A).all()
    (tmp_path / "b.tif").write_bytes(b"II*\0")
    with pytest.raises(Exception, match="b.tif|unpack|read"):
        raster.blocks(spark, str(tmp_path)).count()


def tiled(spark, side=32):
    mask = spark.createDataFrame([(k, r, c, float((r * 5 + c * k) % 17)) for k in (1, 2) for r in range(70) for c in range(45)], "raster_id long, r int, c int, v double")
    scenes = spark.createDataFrame([(k, 45, 70) for k in (1, 2)], "raster_id long, width int, height int")
    return chunks.from_pixels(mask, scenes, "v", side), mask


def names(spark):
    return spark.createDataFrame([(1, "one", *PLACE, 32643, -1.0), (2, "two", *PLACE, 32643, None)], "raster_id long, name string, " + ", ".join(f"t_{k} double" for k in "abcdef") + ", srid int, nodata double")


@pytest.mark.parametrize("tile", [None, 32])
def test_write_and_read_back(spark, tmp_path, tile):
    tiles, pixels = tiled(spark)
    out = str(tmp_path / "out")
    raster.write(raster.of_chunks(tiles, names(spark)), out, tile=tile)
    assert sorted(os.listdir(out)) == ["one.tif", "two.tif"]
    back = raster.pixels(raster.blocks(spark, out)).filter("path like '%two.tif'")
    assert sorted((r["r"], r["c"], r["v"]) for r in back.collect()) == sorted((r["r"], r["c"], r["v"]) for r in pixels.filter("raster_id = 2").collect())
    image = tiff.Image(lambda at, n: (tmp_path / "out" / "one.tif").read_bytes()[at : at + n])
    assert image.transform() == PLACE and image.srid() == 32643 and image.tags[tiff.NODATA][0] == b"-1\0" and image.tiled == bool(tile)
    # the catalog of the library finds them as well
    scenes = {r["path"].rpartition("/")[2]: r for r in files.scenes_of(files.images(spark, out, "*.tif")).collect()}
    assert scenes["one.tif"]["width"] == 45 and scenes["one.tif"]["srid"] == 32643


def test_large_rasters_in_several_files(spark, tmp_path):
    tiles, pixels = tiled(spark)
    out = str(tmp_path / "out")
    raster.write(raster.of_chunks(tiles, names(spark), rows_a_file=32), out)
    assert sorted(os.listdir(out)) == [f"{n}_r{r}.tif" for n in ("one", "two") for r in (0, 32, 64)]
    image = tiff.Image(lambda at, n: (tmp_path / "out" / "one_r32.tif").read_bytes()[at : at + n])
    assert image.height == 32 and image.transform()[5] == PLACE[5] - 16
    back = raster.pixels(raster.blocks(spark, out)).filter("path like '%one_r%'").selectExpr("r + cast(regexp_extract(path, '_r([0-9]+)', 1) as int) r", "c", "v")
    assert sorted(map(tuple, back.collect())) == sorted((r["r"], r["c"], r["v"]) for r in pixels.filter("raster_id = 1").collect())


def test_png(spark, tmp_path):
    rows = [("a.png", 0, 0, 40, 90, 70, 90, 3, 0, "u1", A[:40].tobytes()), ("a.png", 40, 0, 70, 90, 70, 90, 3, 0, "u1", A[40:].tobytes())]
    raster.write(spark.createDataFrame(rows, raster.BLOCKS), str(tmp_path / "out"))
    assert (files.decoded((tmp_path / "out" / "a.png").read_bytes()) == A).all()
    for kind, bands in (("u2", 1), ("u1", 2), ("u1", 4), ("u2", 4)):
        a = (np.arange(5 * 6 * bands).reshape(5, 6, bands) * 37).astype(kind)
        assert (files.decoded(tiff.png(a)) == a).all()
    with pytest.raises(ValueError, match="PNG"):
        tiff.png(np.zeros((2, 2, 5), np.uint8))


def test_nothing_of_a_failed_job_is_left(spark, tmp_path):
    good = ("good.tif", 0, 0, 2, 2, 2, 2, 1, 0, "u1", b"\1\2\3\4")
    bad = ("bad.tif", 0, 0, 2, 2, 2, 2, 1, 0, "u1", b"\1")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="reshape"):
        raster.write(spark.createDataFrame([good, bad], raster.BLOCKS), str(out))
    assert not out.exists() or os.listdir(out) == []
    raster.write(spark.createDataFrame([good], raster.BLOCKS), str(out))
    assert os.listdir(out) == ["good.tif"]
    # rows of a path in two tasks would overwrite one another
    spread = spark.createDataFrame([good, good], raster.BLOCKS).repartition(2)
    with pytest.raises(Exception, match="several tasks|apart"):
        spread.write.format("raster").mode("append").save(str(out))
    assert os.listdir(out) == ["good.tif"]


def test_overwrite_takes_the_place_of_what_was_there(spark, tmp_path):
    row = lambda n: (n, 0, 0, 1, 1, 1, 1, 1, 0, "u1", b"\5")
    for n, mode, want in (("x.tif", "append", ["x.tif"]), ("y.tif", "append", ["x.tif", "y.tif"]), ("z.tif", "overwrite", ["z.tif"])):
        raster.write(spark.createDataFrame([row(n)], raster.BLOCKS), str(tmp_path / "out"), mode)
        assert sorted(os.listdir(tmp_path / "out")) == want
