"""Colour evidence, outlines, image files, enhancement, data-set items and the command line."""

import json
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli, registry_images
from gridloom.operators import components, polygon, segments
from gridloom.plans import enhance, evidence, items
from gridloom.sources import files, scenes, virtual
from tests.test_queries import TABLES, rows

SLOW = {"polygon_measures", "contour_widths"}


@pytest.mark.parametrize("name", sorted(set(registry_images.SQL) - SLOW))
def test_same_rows_as_sql(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = registry_images.QUERIES[name](spark, sf).toPandas(), con.execute(registry_images.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_rings(spark):
    rnd = random.Random(2)
    pixels = {(r, c) for r in range(14) for c in range(14) if rnd.random() < 0.6}
    label = {}
    for p in sorted(pixels):
        if p not in label:
            label[p], todo = p[0] * 100 + p[1], [p]
            while todo:
                r, c = todo.pop()
                for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if q in pixels and q not in label:
                        label[q] = label[p]
                        todo.append(q)
    df = spark.createDataFrame([(0, x, r, c) for (r, c), x in label.items()], "raster_id long, label long, r int, c int")
    area, drawn = Counter(), set()
    for ring in polygon.rings(df).collect():
        g = [(p["x"], p["y"]) for p in ring["geom"]]
        sides = list(zip(g, g[1:], strict=False))
        assert g[0] == g[-1] and sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in sides) == ring["perimeter"]
        assert all((a == c) != (b == d) for (a, b), (c, d) in sides)
        assert all((sides[i][0][0] == sides[i][1][0]) != (sides[i - 1][0][0] == sides[i - 1][1][0]) for i in range(1, len(sides)))
        own = sum(a * d - c * b for (a, b), (c, d) in sides) / 2
        assert own == ring["area"] and (own > 0) == ring["outer"]
        area[ring["label"]] += own
        drawn |= {(ring["label"], ring["ring"])}
    assert area == Counter(label.values()) and len(drawn) > len(set(label.values()))
    assert polygon.rings(df.limit(0)).count() == 0


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(a, filters):
    h, w, n = a.shape
    bits, raw = a.dtype.itemsize * 8, a.astype(a.dtype.newbyteorder(">")).reshape(h, -1).view(np.uint8).astype(int)
    step, out = n * bits // 8, b""
    for i in range(h):
        kind, line, up = filters[i % len(filters)], raw[i], raw[i - 1] if i else np.zeros_like(raw[0])
        left, corner = np.r_[np.zeros(step, int), line[:-step]], np.r_[np.zeros(step, int), up[:-step]]
        p = left + up - corner
        d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, up, corner])
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    head = struct.pack(">IIBBBBB", w, h, bits, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def tiff(a, gsd=None, srid=None, origin=(500000.0, 2500000.0), packed=True):
    h, w, n = a.shape
    strips = [a[i : i + 7].tobytes() for i in range(0, h, 7)]
    strips = [zlib.compress(s) for s in strips] if packed else strips
    blobs, at, offsets = b"", 8, []
    for s in strips:
        offsets.append(at + len(blobs))
        blobs += s
    extra, start, entries = b"", 8 + len(blobs), []

    def tag(number, kind, code, values):
        nonlocal extra
        body = struct.pack("<" + code * len(values), *values)
        if len(body) > 4:
            entries.append((number, kind, len(values), struct.pack("<I", start + len(extra))))
            extra += body + b"\0" * (len(body) % 2)
        else:
            entries.append((number, kind, len(values), body.ljust(4, b"\0")))

    tag(256, 4, "I", [w]), tag(257, 4, "I", [h]), tag(258, 3, "H", [a.dtype.itemsize * 8] * n), tag(259, 3, "H", [8 if packed else 1])
    tag(273, 4, "I", offsets), tag(277, 3, "H", [n]), tag(279, 4, "I", [len(s) for s in strips]), tag(339, 3, "H", [3 if a.dtype.kind == "f" else 1])
    if gsd:
        tag(33550, 12, "d", [gsd, gsd, 0.0]), tag(33922, 12, "d", [0.0, 0.0, 0.0, *origin, 0.0])
    if srid:
        tag(34735, 3, "H", [1, 1, 0, 1, 3072, 0, 1, srid])
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", *e[:3]) + e[3] for e in sorted(entries)) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", start + len(extra)) + blobs + extra + table


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    images = {"a.png": rng.integers(0, 256, (9, 11, 3), np.uint8), "b.png": rng.integers(0, 65536, (6, 5, 1), np.uint16), "c.png": rng.integers(0, 256, (4, 4, 4), np.uint8), "d.tif": rng.integers(0, 65536, (20, 13, 2), np.uint16), "e.tif": rng.random((8, 9, 1)).astype(np.float32)}
    for name, a in images.items():
        (tmp_path / name).write_bytes(png(a, [0, 1, 2, 3, 4]) if name.endswith("png") else tiff(a, 0.3, 32643, packed=name[0] == "d"))
    found = files.images(spark, str(tmp_path))
    got = files.pixels_of(found).toPandas()
    for name, a in images.items():
        own = got[got["path"].str.endswith(name)]
        b = np.zeros(a.shape)
        b[own["r"], own["c"], own["ch"]] = own["v"]
        assert len(own) == a.size and (b == a).all(), name
    s = {r["path"][-5:]: r for r in files.scenes_of(found.filter("path like '%.tif'")).collect()}
    assert (s["d.tif"]["width"], s["d.tif"]["height"], s["d.tif"]["count"], s["d.tif"]["srid"], s["d.tif"]["t_a"], s["d.tif"]["t_e"], s["d.tif"]["t_f"]) == (13, 20, 2, 32643, 0.3, -0.3, 2500000.0)
    (tmp_path / "x.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="cannot read"):
        files.pixels_of(files.images(spark, str(tmp_path))).count()


def test_synthetic_scenes(spark):
    one, two = (scenes.scene(spark, later).toPandas() for later in (False, True))
    changed = (one[["red", "green", "blue"]] != two[["red", "green", "blue"]]).any(axis=1)
    assert len(one) == 1024 * 1024 and 0.3 < changed.sum() / (math.hypot(550, 100) * 20) < 1.1
    at = two.set_index(["r", "c"])
    assert tuple(at.loc[(250, 525), ["red", "green", "blue"]]) == (85, 85, 85) and tuple(at.loc[(650, 600), ["red", "green", "blue"]]) == (70, 70, 70)
    grass = at.loc[(900, 50)]
    assert 40 <= grass["red"] <= 110 and 90 <= grass["green"] <= 170


def test_evidence(spark):
    """A gray road on grass: likely on the road, unlikely off it."""
    size = 96
    px = spark.range(size * size).select(F.lit(0).cast("long").alias("raster_id"), F.floor(F.col("id") / size).cast("int").alias("r"), (F.col("id") % size).cast("int").alias("c"))
    on = F.col("r").between(40, 55)
    bands = px.select("*", F.when(on, 100).when(F.col("r") == 0, 0).when(F.col("r") == 1, 255).otherwise(60).alias("red"), F.when(on, 100).when(F.col("r") == 0, 0).when(F.col("r") == 1, 255).otherwise(180).alias("green"), F.when(on, 100).when(F.col("r") == 0, 0).when(F.col("r") == 1, 255).otherwise(50).alias("blue"))
    size_of = spark.createDataFrame([(0, size, size)], "raster_id long, width int, height int")
    p = evidence.probability(bands, size_of).toPandas().set_index(["r", "c"])["p"]
    assert p.loc[(48, 48)] > 0.75 and p.loc[(80, 48)] < 0.05 and len(p) == size * size and p.between(0, 1).all()


def test_enhancement(spark):
    sizes = spark.createDataFrame([(0, 5, 4, 3), (1, 4, 4, 1), (2, 7, 5, 4)], "raster_id long, width int, height int, count int")
    px = sizes.select("raster_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"), "width", "count").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    px = px.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).select("raster_id", "r", "c", "ch", (F.col("r") * 20 + F.col("c") * 3 + F.col("ch") + F.when(F.col("raster_id") == 2, 9000).otherwise(0)).cast("double").alias("v"))
    seen = []

    def features(p):
        seen.append({(r["raster_id"]["raster_id"], r["raster_id"]["part"]): (r["w"], r["h"]) for r in p.groupBy("raster_id").agg((F.max("c") + 1).alias("w"), (F.max("r") + 1).alias("h")).collect()})
        return p.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(11)))).select("raster_id", "r", "c", "ch", F.lit(0.0).alias("v")).distinct()

    got = {(r["raster_id"], r["r"], r["c"], r["ch"]): r["v"] for r in enhance.enhanced(px, sizes, enhance.shuffle_net(2, features), 2, pre_pad=1).collect()}
    assert got == {(r["raster_id"], 2 * r["r"] + a, 2 * r["c"] + b, r["ch"]): int(r["v"]) for r in px.collect() for a in (0, 1) for b in (0, 1)}
    assert seen[0] == {(0, 0): (6, 6), (1, 0): (6, 6), (2, 0): (8, 6), (2, 1): (8, 6)}


def test_items(spark, sf):
    images = spark.createDataFrame([(i, 30 + i, 60 - i) for i in range(20)], "raster_id long, width int, height int")
    px = images.select("raster_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"), "width").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select("raster_id", "r", "c", (F.col("r") * 1000 + F.col("c")).alias("v"))
    plan = {r["raster_id"]: r for r in items.crop_plan(images, 45).collect()}
    got = items.cropped(px, images, 45).toPandas()
    for i, own in got.groupby("raster_id"):
        a = np.zeros((45, 45), int)
        a[own["r"], own["c"]] = own["v"]
        full = np.add.outer(np.arange(60 - i) * 1000, np.arange(30 + i))
        full = np.pad(full, ((0, max(0, 45 - (60 - i))), (0, max(0, 45 - (30 + i)))), mode="reflect")
        assert (a == full[plan[i]["top"] : plan[i]["top"] + 45, plan[i]["left"] : plan[i]["left"] + 45]).all() and len(own) == 45 * 45
    for turns in range(4):
        square = px.filter("raster_id = 9 and r < 16 and c < 16")
        own = items.turned(square, 16, F.lit(True), F.lit(turns)).toPandas()
        a, b = np.zeros((16, 16), int), np.add.outer(np.arange(16) * 1000, np.arange(16))
        a[own["r"], own["c"]] = own["v"]
        assert (a == np.rot90(b[:, ::-1], turns)).all()
    with pytest.raises(Exception, match="do not fit"):
        items.paired_plan(images.withColumns({"lq_width": F.lit(5), "lq_height": F.lit(5)}), 128, 4).count()
    flat = spark.range(3).select(F.col("id").alias("raster_id"), F.lit(32).alias("side"), F.array_repeat(F.lit(0.5), 1024).alias("pixels"))
    lq = items.degraded(flat).collect()
    assert [len(r["lq"]) for r in lq] == [64] * 3 and all(0.3 < np.mean(r["lq"]) < 0.7 for r in lq) and lq == items.degraded(flat).collect()
    k = items.low_pass(2.0, 21)
    assert np.isclose(k, k.T).all() and k.argmax() == 220 and math.isclose(k.sum(), 1)
    pool = items.pool_plan(images.withColumn("idx", F.col("raster_id")), 8).collect()
    assert sorted(r["out"] for r in pool) == list(range(20)) and any(r["out"] != r["raster_id"] for r in pool) and all(r["out"] // 8 == r["idx"] // 8 for r in pool)


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def test_polygons_with_holes_and_several_pieces(spark):
    """Areas equal pixels, outer rings run against the clock, holes with it; pieces that touch at corners are polygons of their own."""
    art = {1: ["#.", ".#"], 2: ["#####", "#...#", "#.#.#", "#...#", "#####"], 3: ["####", "#..#", "#.##", "####"], 4: ["#####", "##..#", "#.#.#", "#..##", "#####"], 5: ["#"]}
    cells = [(k, r, c) for k, rows in art.items() for r, line in enumerate(rows) for c, x in enumerate(line) if x == "#"]
    m = spark.createDataFrame(cells, "raster_id long, r int, c int")
    labels = components.label(m)
    found = polygon.polygons(polygon.rings(labels), labels)
    pixels = {(r["raster_id"], r["label"]): r["count"] for r in labels.groupBy("raster_id", "label").count().collect()}
    assert {k: sum(r["area"] for r in found.collect() if (r["raster_id"], r["label"]) == k) for k in pixels} == pixels
    catalog = spark.createDataFrame([(k, *((0.5, 0.0, 10.0, 0.0, -0.5, 20.0) if k != 5 else (None,) * 6), 32643 if k != 5 else None) for k in art], "raster_id long, " + ", ".join(f"t_{x} double" for x in "abcdef") + ", srid int")
    shapes = {(r["raster_id"], r["label"]): json.loads(r["value"])["geometry"] for r in files.polygon_features(found, catalog).collect()}
    assert {k[0] for k in shapes} == {1, 2, 3, 4}
    for k, g in shapes.items():
        parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
        assert len(parts) > 1 or g["type"] == "Polygon"
        for outer, *holes in parts:
            assert shoelace(outer) > 0 and all(shoelace(h) < 0 for h in holes) and all(ring[0] == ring[-1] for ring in (outer, *holes))
        assert sum(shoelace(ring) for part in parts for ring in part) == pixels[k] / 4
    kinds = {k: sorted((g["type"], len(g["coordinates"])) for (i, _), g in shapes.items() if i == k) for k in art}
    # two pixels at a corner; a ring with an island in its hole; a hole with a notch; a band through a ring that touches it at corners
    assert kinds[1] == [("MultiPolygon", 2)] and kinds[2] == [("Polygon", 1), ("Polygon", 2)] and kinds[3] == [("Polygon", 2)]
    assert kinds[4][0][0] == "MultiPolygon"


def test_each_scene_has_its_own_ground_distance(spark, tmp_path):
    """A fine and a coarse scene of the same pixels: widths and lengths differ by the factor between them."""
    a = np.full((80, 120, 3), 40, np.uint8)
    a[:, :, 1], a[30:50] = 160, 100
    a[0, 0], a[0, 1] = 0, 255
    (tmp_path / "in").mkdir()
    for name, gsd in (("fine", 0.25), ("coarse", 1.0)):
        (tmp_path / "in" / f"{name}.tif").write_bytes(tiff(a, gsd, 32643))
    scenes = {r["raster_id"]: r["path"].rpartition("/")[2] for r in cli.catalog(spark, str(tmp_path / "in"))[0].collect()}
    cli.extracted(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert set(scenes.values()) == {"fine.tif", "coarse.tif"}
    labels = spark.createDataFrame([(i, 5, c, 5) for i in (1, 2) for c in range(10)], "raster_id long, r int, c int, label long")
    values = labels.drop("label").withColumns({"dist": F.lit(4.0), "p": F.lit(0.5)})
    each = spark.createDataFrame([(1, 0.25), (2, 1.0)], "raster_id long, gsd double")
    got = {r["raster_id"]: (r["mean_width_m"], r["length_m"], r["qualifies"]) for r in segments.segment_metrics(labels, values.drop("p"), values.drop("dist"), each, width_m=6.0, length_m=5.0).collect()}
    assert got == {1: (2.0, 2.5, False), 2: (8.0, 10.0, True)}
    roads = spark.read.parquet(str(tmp_path / "out" / "roads")).collect()
    # middles of pixels of the coarse scene end in a half, those of the fine one in eighths
    assert roads and all(r["length_m"] == round(len(r["geom"]) * (1.0 if r["geom"][0]["x"] % 1 == 0.5 else 0.25), 2) for r in roads)


def test_command_line(spark, tmp_path, capsys, sf):
    rng = np.random.default_rng(3)
    a = np.stack([rng.integers(50, 70, (120, 150)), rng.integers(150, 190, (120, 150)), rng.integers(40, 60, (120, 150))], -1).astype(np.uint8)
    a[50:75, :, :], a[0, 0], a[0, 1] = 100, 0, 255
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.tif").write_bytes(tiff(a, 0.3, 32643))
    cli.main(["inspect", str(tmp_path / "in")])
    out = capsys.readouterr().out
    assert "150 x 120" in out and "EPSG:32643" in out and "0.3" in out
    cli.main(["extract", str(tmp_path / "in"), str(tmp_path / "out")])
    found = spark.read.parquet(str(tmp_path / "out" / "roads")).collect()
    assert found and all(abs(r["mean_width_m"] - 7.5) < 2.5 for r in found) and spark.read.text(str(tmp_path / "out" / "roads_geojson")).count() == len(found)
    for name in ("before", "after"):
        virtual.roads(spark, sf, name).limit(60).write.parquet(str(tmp_path / name))
    cli.main(["change", str(tmp_path / "before"), str(tmp_path / "after"), str(tmp_path / "changes")])
    assert "all_changes" in capsys.readouterr().out
