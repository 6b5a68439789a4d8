"""Sub-images of every scene, small ones too, beside the reference's default size."""

import duckdb
import pytest

from gridloom import registry

#: Crop size, step and the pixels that may be left over.
SIZES = ((240, 120, 60), (480, 240, 0))


def starts(n, crop, step, thresh):
    out = list(range(0, n - crop + 1, step))
    return out + [n - crop] if out and n - (out[-1] + crop) > thresh else out


def wanted(scenes):
    out = []
    for crop, step, thresh in SIZES:
        for key, width, height in scenes:
            places = [(r, c) for r in starts(height, crop, step, thresh) for c in starts(width, crop, step, thresh)]
            out += [(key, i, c, r, f"_s{i:03d}", crop) for i, (r, c) in enumerate(places, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("raster_id", "crop_id", "col_off", "row_off", "suffix", "crop_size").collect())


def test_every_scene_has_crops(spark, sf):
    parts = [tuple(r) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").collect()]
    got = rows(registry.queries()["subimage_grid"](spark, sf))
    assert {r[0] for r in got} == {k for k, _ in parts}
    assert got == wanted([(k, 256 + k % 1800, 256 + p * 37 % 1300) for k, p in parts])


@pytest.mark.parametrize("engine", ("spark", "sql"))
def test_both_sizes_of_large_scenes(spark, tmp_path, engine):
    # 479, 480 and 481 pixels on one side, a wide scene, and the smallest one
    parts = [(223, 35), (224, 35), (225, 35), (1799, 34), (1800, 0)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = wanted([(k, 256 + k % 1800, 256 + p * 37 % 1300) for k, p in parts])
    assert {r[5] for r in want if r[0] == 223} == {240} and {r[5] for r in want if r[0] == 224} == {240, 480}
    if engine == "spark":
        assert rows(registry.queries()["subimage_grid"](spark, str(tmp_path))) == want
    else:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
        assert sorted(con.execute(f"SELECT raster_id, crop_id, col_off, row_off, suffix, crop_size FROM ({registry.oracle_sql()['subimage_grid']})").fetchall()) == want
