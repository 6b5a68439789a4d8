"""The relations of the engine. Every operator gives one of these, empty or not.

A raster is a relation (raster_id, r, c, value): r and c count rows and columns from 0. A mask or a
skeleton is the relation of its foreground pixels. Geometry is an array of points with an SRID
beside it.
"""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PIXEL = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])

RASTER = "raster_id long, r int, c int, v double"
BANDS = "raster_id long, band int, r int, c int, v double"
MASK = "raster_id long, r int, c int"
PROBABILITY = "raster_id long, r int, c int, p double"
LABELS = "raster_id long, r int, c int, label long"

#: A scene of the catalog: size, bands, position, and the six numbers of its affine transform.
METADATA = T.StructType(
    [
        T.StructField("raster_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("srid", T.IntegerType()),
        T.StructField("crs_wkt", T.StringType()),
        *(T.StructField(f"t_{k}", T.DoubleType()) for k in "abcdef"),
        T.StructField("nodata", T.DoubleType()),
        T.StructField("projected", T.BooleanType()),
    ]
)

TILE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("tile_id", "col_off", "row_off", "width", "height", "source_width", "source_height")])

SEGMENT = T.StructType(
    [
        T.StructField("raster_id", T.LongType()),
        T.StructField("segment_id", T.LongType()),
        T.StructField("coords", T.ArrayType(PIXEL)),
        *(T.StructField(n, T.DoubleType()) for n in ("length_m", "mean_width_m", "median_width_m", "min_width_m", "max_width_m")),
        T.StructField("qualifies", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

ROADS = T.StructType(
    [
        T.StructField("road_id", T.LongType()),
        *(T.StructField(n, T.DoubleType()) for n in ("length_m", "mean_width_m", "median_width_m", "min_width_m", "max_width_m", "confidence")),
        T.StructField("qualifies", T.BooleanType()),
        T.StructField("geom", T.ArrayType(POINT)),
        T.StructField("srid", T.IntegerType()),
    ]
)

CHANGES = "change_type string, source_id long, part int, length_m double, width_m double, confidence double, geom array<struct<x:double,y:double>>"
