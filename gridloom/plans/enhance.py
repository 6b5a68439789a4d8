"""Super-resolution as a dataflow: pad, predict, crop, and write back by image mode.

Images are pixels (raster_id, r, c, ch, v). The network is a function from such rows to such rows, for
instance one that wraps ``pyspark.ml.functions.predict_batch_udf``; :func:`shuffle_net` shows the
last steps of a compact network without trained weights: pixel shuffle and a nearest residual.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.stretch import output_scale

Net = Callable[[DataFrame], DataFrame]
KEYS = ["raster_id", "r", "c", "ch"]
#: Networks by name: scale, kind, blocks or convolutions; a caller's own table may stand in.
MODELS = (("residual_x4", 4, "residual", 23), ("residual_x4_small", 4, "residual", 6), ("residual_x2", 2, "residual", 23), ("compact_x4", 4, "compact", 16), ("compact_x4_general", 4, "compact", 32))
#: The network that has a second set of weights for noisy images, and the name of that set.
NOISY = ("compact_x4_general", "compact_x4_noisy")


def models(spark: SparkSession, table=MODELS) -> DataFrame:
    return spark.createDataFrame(table, "name string, scale int, kind string, depth int")


def model_weights(names: DataFrame, strength: float = 1.0) -> DataFrame:
    """(name, file, weight): the sets of weights a network is made of; below full strength the noisy one takes a part."""
    base = F.split("name", r"\.")[0]
    own, other = F.struct(base.alias("file"), F.lit(strength).alias("weight")), F.struct(F.lit(NOISY[1]).alias("file"), F.lit(1 - strength).alias("weight"))
    alone = F.struct(base.alias("file"), F.lit(1.0).alias("weight"))
    sets = F.when((base == NOISY[0]) & F.lit(strength != 1.0), F.array(own, other)).otherwise(F.array(alone))
    return names.select(base.alias("name"), F.explode(sets).alias("s")).select("name", F.concat("s.file", F.lit(".pth")).alias("file"), F.col("s.weight").alias("weight"))


def image_mode(bands: Column) -> Column:
    """Gray, colour, or colour with an opacity band."""
    return F.when(bands == 1, "L").when(bands == 4, "RGBA").otherwise("RGB")


def value_range(pixels: DataFrame) -> DataFrame:
    """(raster_id, top): 65535 where a value exceeds 256, else 255."""
    return pixels.groupBy("raster_id").agg(F.when(F.max("v") > 256, F.lit(65535)).otherwise(F.lit(255)).alias("top"))


def padding(scenes: DataFrame, scale: int, pre_pad: int = 0) -> DataFrame:
    """(raster_id, width, height, pad_w, pad_h): sizes with the pad before, and what is missing to a multiple of 2 (scale 2) or 4 (scale 1)."""
    multiple = {2: 2, 1: 4}.get(scale, 1)
    w, h = F.col("width") + pre_pad, F.col("height") + pre_pad
    return scenes.select("raster_id", w.alias("width"), h.alias("height"), F.pmod(-w, F.lit(multiple)).cast("int").alias("pad_w"), F.pmod(-h, F.lit(multiple)).cast("int").alias("pad_h"))


def padded(pixels: DataFrame, scenes: DataFrame, scale: int, pre_pad: int = 0) -> DataFrame:
    """Pixels with the pads to the right and below filled by reflection; pads are smaller than the image."""
    pads = padding(scenes, scale, pre_pad).select("raster_id", (F.col("width") + F.col("pad_w")).alias("_w"), (F.col("height") + F.col("pad_h")).alias("_h"))
    p = pixels.join(pads, "raster_id").join(scenes.select("raster_id", "width", "height"), "raster_id")

    def places(i: str, n: str, full: str) -> Column:
        """Where a pixel goes: its own place, and that beyond the border which mirrors it."""
        mirror = 2 * (F.col(n) - 1) - F.col(i)
        return F.when((mirror >= F.col(n)) & (mirror < F.col(full)), F.array(F.col(i), mirror)).otherwise(F.array(F.col(i)))

    p = p.withColumn("_r", F.explode(places("r", "height", "_h"))).withColumn("_c", F.explode(places("c", "width", "_w")))
    return p.select("raster_id", F.col("_r").cast("int").alias("r"), F.col("_c").cast("int").alias("c"), "ch", "v")


def pixel_shuffle(features: DataFrame, factor: int) -> DataFrame:
    """Channels of groups of factor * factor become pixels: (r, c, ch) goes to row r * factor + (ch % factor^2) / factor."""
    k = F.col("ch") % (factor * factor)
    return features.select("raster_id", (F.col("r") * factor + F.floor(k / factor)).cast("int").alias("r"), (F.col("c") * factor + k % factor).cast("int").alias("c"), F.floor(F.col("ch") / (factor * factor)).cast("int").alias("ch"), "v")


def nearest_up(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel as a square of equal ones."""
    steps = F.array(*map(F.lit, range(factor)))
    p = pixels.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
    return p.select("raster_id", (F.col("r") * factor + F.col("_a")).cast("int").alias("r"), (F.col("c") * factor + F.col("_b")).cast("int").alias("c"), "ch", "v")


def shuffle_net(factor: int, features: Net) -> Net:
    """A network from a function to features: pixel shuffle of the features plus the nearest enlargement of the image."""

    def run(pixels: DataFrame) -> DataFrame:
        body = pixel_shuffle(features(pixels), factor).withColumnRenamed("v", "_f")
        return nearest_up(pixels, factor).join(body, KEYS, "left").select(*KEYS, (F.col("v") + F.coalesce("_f", F.lit(0.0))).alias("v"))

    return run


def probability_of(pixels: DataFrame) -> DataFrame:
    """Raw scores to 0..1 where a raster's leave that range: by the logistic function; others stay."""
    ends = pixels.groupBy("raster_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return pixels.join(ends, "raster_id").withColumn("p", F.when((F.col("_lo") < 0) | (F.col("_hi") > 1), 1 / (1 + F.exp(-F.col("v")))).otherwise(F.col("v"))).drop("_lo", "_hi")


def enhanced(pixels: DataFrame, scenes: DataFrame, net: Net, scale: int, pre_pad: int = 0) -> DataFrame:
    """(raster_id, r, c, ch, v): the image scaled, in whole numbers of its own range; scenes has the number of bands ``count``.

    Opacity (the fourth band) goes through the network as three equal bands, whose mean is taken."""
    tops = value_range(pixels)
    unit = pixels.join(tops, "raster_id").select(*KEYS, (F.col("v") / F.col("top")).alias("v"))
    spread = F.when(F.col("mode") == "L", F.array(*(F.lit(k) for k in range(3)))).when(F.col("ch") == 3, F.array(*(F.lit(k) for k in range(4, 7)))).otherwise(F.array("ch"))
    three = unit.join(scenes.select("raster_id", image_mode(F.col("count")).alias("mode")), "raster_id")
    # rows 0..2 are colours, 4..6 the opacity: two images to the network
    three = three.withColumn("ch", F.explode(spread)).select(F.struct("raster_id", F.floor(F.col("ch") / 4).alias("part")).alias("image"), "r", "c", F.pmod("ch", F.lit(4)).cast("int").alias("ch"), "v")
    sizes = scenes.select("raster_id", "width", "height", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("part")).select(F.struct("raster_id", "part").alias("raster_id"), "width", "height")
    out = net(padded(three.withColumnRenamed("image", "raster_id"), sizes, scale, pre_pad))
    out = out.select(F.col("raster_id.raster_id").alias("raster_id"), F.col("raster_id.part").alias("part"), "r", "c", "ch", "v")
    whole = out.join(scenes.select("raster_id", "width", "height", image_mode(F.col("count")).alias("mode")), "raster_id").join(tops, "raster_id")
    whole = whole.filter((F.col("r") < F.col("height") * scale) & (F.col("c") < F.col("width") * scale))
    channel = F.when(F.col("part") == 1, F.lit(3)).when(F.col("mode") == "L", F.lit(0)).otherwise(F.col("ch"))
    v = output_scale(F.avg("v"), F.first("top") == 65535)
    return whole.groupBy("raster_id", "r", "c", channel.alias("ch")).agg(v.alias("v"))


def output_name(path: Column, mode: Column, suffix: str = "out", extension: str = "auto") -> Column:
    """Name of the file an image is written to: ``auto`` keeps the extension, images with opacity are PNG."""
    name = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    own = F.regexp_extract(path, r"\.([^./]*)$", 1)
    kind = F.when(mode == "RGBA", F.lit("png")).otherwise(own if extension == "auto" else F.lit(extension))
    return F.concat(name, F.lit(f"_{suffix}." if suffix else "."), kind)


