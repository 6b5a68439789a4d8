import numpy as np
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions import geometry
from gridloom.operators import blend, components, distance, mask, segments, skeleton, stencil, stretch, tiling
from gridloom.plans import change, extract, lists
from gridloom.sources import files
from gridloom.streaming import frames


def scenes(spark, w, h):
    return spark.createDataFrame([(0, w, h)], "raster_id long, width int, height int")


def to_mask(spark, a):
    return spark.createDataFrame([(0, int(r), int(c)) for r, c in np.argwhere(a)], schema.MASK)


def to_raster(spark, a, name="v"):
    return spark.createDataFrame([(0, r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], f"raster_id long, r int, c int, {name} double")


def to_array(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r["r"], r["c"]] = True
    return out


def test_tile_plan(spark):
    t = tiling.windows(scenes(spark, 2048, 1536), 512, 128).collect()
    assert len(t) == 20
    assert all(x["col_off"] + x["tile_width"] <= 2048 and x["row_off"] + x["tile_height"] <= 1536 for x in t)
    assert sorted(x["tile_id"] for x in t) == list(range(20))
    tiling.register(spark)
    assert spark.sql("SELECT * FROM tile_plan(2048, 1536, 512, 128)").count() == 20


def test_blend_of_a_constant(spark):
    tiles = tiling.windows(scenes(spark, 90, 70), 32, 8)
    p = tiling.tile_pixels(tiles).withColumn("p", F.lit(0.8))
    out = blend.blend_gaussian(p, 32).agg(F.min("p"), F.max("p"), F.count(F.lit(1))).first()
    assert abs(out[0] - 0.8) < 1e-9 and abs(out[1] - 0.8) < 1e-9 and out[2] == 90 * 70


def test_wide_road_qualifies_and_narrow_one_does_not(spark):
    a = np.zeros((60, 120), bool)
    a[20:40, 10:110] = True
    line = np.zeros_like(a)
    line[30, 20:100] = True
    m, sk = to_mask(spark, a), to_mask(spark, line)
    prob = m.withColumn("p", F.lit(0.85))
    s = segments.segment_metrics(components.label(sk), distance.distance(m, scenes(spark, 120, 60)), prob, 0.3, width_m=5.5, length_m=10.0).collect()
    assert len(s) == 1 and abs(s[0]["mean_width_m"] - 6.0) <= 0.8 and s[0]["qualifies"] and s[0]["confidence"] == 0.85
    a[:] = False
    a[28:33, 10:110] = True
    m = to_mask(spark, a)
    s = segments.segment_metrics(components.label(sk), distance.distance(m, scenes(spark, 120, 60)), m.withColumn("p", F.lit(0.9)), 0.3).collect()
    assert len(s) == 1 and s[0]["mean_width_m"] < 3.2 and not s[0]["qualifies"]


def test_components_across_blocks(spark):
    rng = np.random.default_rng(1)
    a = rng.random((40, 50)) < 0.35
    got = {(r["r"], r["c"]): r["label"] for r in components.label(to_mask(spark, a), block=8).collect()}
    seen, want = set(), {}
    for r, c in map(tuple, np.argwhere(a)):
        if (r, c) in seen:
            continue
        todo, own = [(r, c)], []
        seen.add((r, c))
        while todo:
            x = todo.pop()
            own.append(x)
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    y = (x[0] + i, x[1] + j)
                    if 0 <= y[0] < 40 and 0 <= y[1] < 50 and a[y] and y not in seen:
                        seen.add(y)
                        todo.append(y)
        low = min(i * components.STRIDE + j for i, j in own)
        want |= {(int(i), int(j)): low for i, j in own}
    assert got == want


def test_skeleton_is_thin_inside_and_stable(spark):
    a = np.zeros((40, 60), bool)
    a[10:17, 5:55] = True
    a[5:35, 30:36] = True
    m = to_mask(spark, a)
    s = to_array(skeleton.skeleton(m), a.shape)
    assert s.any() and not (s & ~a).any() and s.sum() < a.sum() / 3
    assert (to_array(skeleton.skeleton(to_mask(spark, s)), a.shape) == s).all()
    assert (s == skeleton.thin(a)).all()


def test_gap_is_bridged(spark):
    a = np.zeros((30, 80), bool)
    a[15, 5:35] = a[15, 45:75] = True
    prob = to_raster(spark, np.full(a.shape, 0.5), "p")
    out = to_array(skeleton.bridged(to_mask(spark, a), prob, gap=25.0), a.shape)
    assert out[15, 6:74].all()


def test_distance_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a = rng.random((25, 30)) < 0.8
    got = {(r["r"], r["c"]): r["dist"] for r in distance.distance(to_mask(spark, a), scenes(spark, 30, 25)).collect()}
    empty = np.argwhere(~a)
    for p in map(tuple, np.argwhere(a)):
        assert abs(got[tuple(map(int, p))] - np.sqrt(((empty - p) ** 2).sum(1).min())) < 1e-9


def test_morphology_and_stretch(spark):
    rng = np.random.default_rng(3)
    a = rng.random((20, 24)) < 0.5
    pad = np.pad(a, 1)
    want = np.max([pad[i : i + 20, j : j + 24] for i in range(3) for j in range(3)], axis=0)
    sc = scenes(spark, 24, 20)
    assert (to_array(mask.dilate(to_mask(spark, a), sc), a.shape) == want).all()
    pad = np.pad(a, 1, constant_values=True)
    want = np.min([pad[i : i + 20, j : j + 24] for i in range(3) for j in range(3)], axis=0)
    assert (to_array(mask.erode(to_mask(spark, a), sc), a.shape) == want).all()
    v = rng.random((20, 24))
    p = {(r["r"], r["c"]): r["p"] for r in stretch.percentile_stretch(to_raster(spark, v)).collect()}
    lo, hi = np.percentile(v, [2, 98])
    assert all(abs(p[i, j] - min(max((v[i, j] - lo) / (hi - lo), 0), 1)) < 1e-9 for i in range(20) for j in range(24))


def test_ridge_filters_find_a_line(spark):
    v = np.zeros((40, 40))
    v[19:22, :] = 1
    sc = scenes(spark, 40, 40)
    for found in (stencil.frangi(to_raster(spark, v), sc, (1.2, 2.0)), stencil.ribbon_energy(to_raster(spark, v), (2.5,), 8)):
        by_row = {r["r"]: r["m"] for r in found.filter("c between 10 and 30").groupBy("r").agg(F.avg("v").alias("m")).collect()}
        assert max(by_row, key=by_row.get) == 20 and by_row[20] > 5 * by_row.get(5, 0)


def roads(spark, rows):
    point = "array<struct<x:double,y:double>>"
    return spark.createDataFrame(rows, f"road_id long, mean_width_m double, confidence double, geom {point}, srid int")


def test_change_of_networks(spark):
    before = roads(spark, [(1, 7.0, 0.9, [(0.0, 0.0), (100.0, 0.0)], 32643), (2, 6.5, 0.85, [(0.0, 50.0), (100.0, 50.0)], 32643)])
    after = roads(spark, [(1, 7.0, 0.9, [(0.0, 0.0), (100.0, 0.0)], 32643), (3, 8.0, 0.92, [(0.0, 100.0), (100.0, 100.0)], 32643)])
    got = {(r["change_type"], r["source_id"], r["part"], r["length_m"]) for r in change.compare(before, after, 5.0, 10.0).collect()}
    assert got == {("NEW_ROAD", 3, 1, 100.0), ("REMOVED_ROAD", 2, 1, 100.0)}
    # the uncovered rest of a line of two segments is one part
    bent = roads(spark, [(9, 5.0, 1.0, [(0.0, 0.0), (50.0, 0.0), (50.0, 60.0)], 32643)])
    left = change.changes_of(bent, roads(spark, [(1, 5.0, 1.0, [(0.0, 0.0), (30.0, 0.0)], 32643)]), "NEW_ROAD", 5.0, 10.0).collect()
    assert [(r["part"], r["length_m"], len(r["geom"])) for r in left] == [(1, 75.0, 3)]
    assert change.compare(before.limit(0), after.limit(0)).count() == 0


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(500000.0, 2500000.0, 32643), (612345.6, 6543210.9, 32733)], "x double, y double, srid int")
    lon, lat = geometry.from_utm(F.col("x"), F.col("y"), F.col("srid"))
    x, y = geometry.to_utm(F.col("lon"), F.col("lat"), F.col("srid"))
    for r in df.withColumns({"lon": lon, "lat": lat}).withColumns({"x2": x, "y2": y}).collect():
        assert abs(r["x"] - r["x2"]) < 0.01 and abs(r["y"] - r["y2"]) < 0.01


def test_the_whole_chain(spark):
    v = np.zeros((64, 96))
    v[28:36, 4:92] = 1
    sc = spark.createDataFrame([(0, 96, 64, 32643, 0.5, 0.0, 500000.0, 0.0, -0.5, 2500000.0)], "raster_id long, width int, height int, srid int, t_a double, t_b double, t_c double, t_d double, t_e double, t_f double")
    found = extract.extract(to_raster(spark, v), sc, 1.0, tile=48, overlap=16)
    line = extract.lines(found, sc).collect()
    assert len(line) == 1 and line[0]["mean_width_m"] > 6 and len(line[0]["geom"]) > 60
    assert '"LineString"' in files.features(extract.lines(found, sc), ["road_id"]).first()["value"]


def test_lists(spark, tmp_path):
    a = spark.createDataFrame([("b.png",), ("a.png",), ("c.png",)], "path string")
    got = [(r["idx"], r["gt_path"], r["lq_path"]) for r in lists.zip_sorted(a, a).orderBy("idx").collect()]
    assert got == [(0, "a.png", "a.png"), (1, "b.png", "b.png"), (2, "c.png", "c.png")]
    files.write_list(a, str(tmp_path / "list"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "list")).collect()) == ["a.png", "b.png", "c.png"]


def test_stream_of_frames(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).selectExpr("id", "id % 2 AS kind").write.parquet(src)
    stream = frames.arriving(spark, src, "id long, kind long")
    frames.each_batch(stream, lambda b: b.groupBy("kind").count(), out, str(tmp_path / "check")).awaitTermination(60)
    assert {r["kind"]: r["count"] for r in spark.read.parquet(out).collect()} == {0: 5, 1: 5}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], schema.MASK)
    sc = scenes(spark, 10, 10)
    for df in (mask.dilate(empty, sc), mask.close_open(empty, sc), components.label(empty), skeleton.skeleton(empty), distance.distance(empty, sc), stencil.endpoints(empty)):
        assert df.count() == 0
