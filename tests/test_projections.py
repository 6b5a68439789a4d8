"""Projections against published examples, and back."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as g

CLARKE = {"axis": 6378206.4, "flattening": 1 / 294.978698214}
#: projection, longitude, latitude, easting, northing, and how far the printed figures go
EXAMPLES = {
    "web mercator": (g.SYSTEMS[3857], -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600, -11169055.58, 2800000.00, 0.02),
    "lambert, Texas in feet": (g.Projection("lambert", 27 + 50 / 60, -99.0, 28 + 23 / 60, 30 + 17 / 60, 2000000.0, 0.0, 20925832.16, 1 / 294.9786982), -96.0, 28.5, 2963503.91, 254759.80, 0.02),
    "albers, United States": (g.Projection("albers", 23.0, -96.0, 29.5, 45.5, **CLARKE), -75.0, 35.0, 1885472.7, 1535925.0, 0.06),
    "lambert, United States": (g.Projection("lambert", 23.0, -96.0, 33.0, 45.0, **CLARKE), -75.0, 35.0, 1894410.9, 1564649.5, 0.06),
}


@pytest.mark.parametrize("name", EXAMPLES)
def test_published_examples(spark, name):
    p, lon, lat, x, y, printed = EXAMPLES[name]
    px, py = g.projected(F.lit(lon), F.lit(lat), p)
    got = spark.range(1).select(px.alias("x"), py.alias("y")).first()
    assert abs(got["x"] - x) <= printed and abs(got["y"] - y) <= printed
    back_lon, back_lat = g.unprojected(F.lit(got["x"]), F.lit(got["y"]), p)
    back = spark.range(1).select(back_lon.alias("lon"), back_lat.alias("lat")).first()
    # 1e-9 degrees are a tenth of a millimetre
    assert abs(back["lon"] - lon) < 1e-9 and abs(back["lat"] - lat) < 1e-8


@pytest.mark.parametrize("srid", [3857, 2154, 5070, 3034, 32631, 32731])
def test_there_and_back(spark, srid):
    south = srid == 32731
    grid = spark.range(100).select((F.lit(-100.0 if srid == 5070 else 0.0) + F.col("id") % 10 * 0.6).alias("lon"), (F.lit(-50.0 if south else 36.0) + F.floor(F.col("id") / 10) * 1.3).alias("lat"))
    geom = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    there = grid.withColumn("there", g.reproject(geom, F.lit(4326), F.lit(srid)))
    back = there.withColumn("back", g.to_wgs84(F.col("there"), F.lit(srid))[0]).collect()
    assert all(abs(r["back"]["x"] - r["lon"]) < 1e-8 and abs(r["back"]["y"] - r["lat"]) < 1e-8 for r in back)


def test_between_systems_and_what_is_not_supported(spark):
    one = spark.createDataFrame([(448251.8, 5411932.7)], "x double, y double")
    geom = F.array(F.struct("x", "y"))
    lam = one.select(g.reproject(geom, F.lit(32631), F.lit(2154))[0].alias("p"))
    back = lam.select(g.reproject(F.array("p"), F.lit(2154), F.lit(32631))[0].alias("p")).first()["p"]
    assert abs(back["x"] - 448251.8) < 1e-3 and abs(back["y"] - 5411932.7) < 1e-3
    with pytest.raises(Exception, match="27700"):
        one.select(g.reproject(geom, F.lit(27700), F.lit(4326))).collect()
