"""Lists of files, pairs and frames, merged settings and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import written


def meta_paths(lines: DataFrame, root: str) -> DataFrame:
    """The first word of each line of a list, under a root."""
    return lines.select(F.concat_ws("/", F.lit(root), F.split("value", " ")[0]).alias("path"))


def meta_pairs(lines: DataFrame, root_a: str, root_b: str) -> DataFrame:
    """Lines ``first, second`` as two paths."""
    two = F.split("value", ", ")
    return lines.select(F.concat_ws("/", F.lit(root_a), two[0]).alias("gt_path"), F.concat_ws("/", F.lit(root_b), two[1]).alias("lq_path"))


def keys(lines: DataFrame) -> DataFrame:
    """What stands before the first dot of each line."""
    return lines.select(F.substring_index("value", ".", 1).alias("key"))


def numbered(paths: DataFrame, col: str = "path", partitions: int | None = None) -> DataFrame:
    """Rows with their place (from 0) in sorted order.

    Rows are dealt by range, written once (a second deal could draw other ranges), and counted in their
    partitions; only the partitions' counts meet in one task."""
    part = F.spark_partition_id()
    dealt = paths.repartitionByRange(partitions, col) if partitions else paths.repartitionByRange(col)
    rows = written(dealt.withColumn("_part", part), "ranges")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(col)))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min(col).alias("_first"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_first", "_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    return rows.join(base, "_part").withColumn("idx", F.col("_base") + F.col("_k") - 1).drop("_part", "_k", "_base")


def zip_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two lists of paths paired by place; an error when the query runs if one is longer."""
    left, right = numbered(a.select(F.col("path").alias("gt_path")), "gt_path"), numbered(b.select(F.col("path").alias("lq_path")), "lq_path")
    both = left.join(right, "idx", "full")
    whole = F.assert_true(F.col("gt_path").isNotNull() & F.col("lq_path").isNotNull(), "lists of different lengths")
    return both.filter(whole.isNull()).select("idx", "gt_path", "lq_path")


def worker_of(idx: Column, n: Column, workers: int) -> Column:
    """Blocks of ceil(n / workers) items."""
    return F.floor(idx / F.ceil(n / F.lit(workers)))


def time_slice_of(t: Column, duration: Column, parts: int) -> Column:
    """Equal slices of whole seconds, the last one open-ended."""
    return F.least(F.floor(t / F.greatest(F.floor(duration / F.lit(parts)), F.lit(1))), F.lit(parts - 1))


def merged_settings(base: DataFrame, override: DataFrame) -> DataFrame:
    """Settings (key, value) with flattened keys: an override takes precedence and may add keys."""
    o = override.select("key", F.col("value").alias("_o"), F.lit(True).alias("_has"))
    return base.join(o, "key", "full").select("key", F.when(F.col("_has"), F.col("_o")).otherwise(F.col("value")).alias("value"))


def weight_keys(keys_: DataFrame) -> DataFrame:
    """Names of weights without the prefix of a parallel wrapper."""
    return keys_.withColumn("key", F.regexp_replace("key", r"^module\.", ""))


def interpolated(a: DataFrame, b: DataFrame, w_a: float, w_b: float) -> DataFrame:
    """Weighted sum of two sets of weights (key, w); an error if b lacks a key of a."""
    j = a.join(b.select("key", F.col("w").alias("_b")), "key", "left")
    known = F.when(F.col("_b").isNull(), F.raise_error(F.concat(F.lit("no weights for "), F.col("key").cast("string"))).cast("array<double>")).otherwise(F.col("_b"))
    return j.select("key", F.zip_with("w", known, lambda x, y: F.lit(w_a) * x + F.lit(w_b) * y).alias("w"))


def scaled_sizes(images: DataFrame, scales=(0.75, 0.5, 1 / 3), shortest: int = 400) -> DataFrame:
    """Sizes of an image at several scales and with a shortest side of 400."""
    s = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(float(x)).alias("scale")) for k, x in enumerate(scales)))
    rows = images.select("*", F.explode(s).alias("_s")).select("raster_id", F.col("_s.n").alias("n"), F.floor(F.col("width") * F.col("_s.scale")).alias("out_w"), F.floor(F.col("height") * F.col("_s.scale")).alias("out_h"))
    side = F.least("width", "height")
    last = images.select("raster_id", F.lit(len(scales)).alias("n"), F.floor(F.col("width") * shortest / side).alias("out_w"), F.floor(F.col("height") * shortest / side).alias("out_h"))
    return rows.unionByName(last)


def checkpoint_entries(entries: DataFrame) -> DataFrame:
    """Weights (key, ...) of a checkpoint: of the wrappers state_dict, model_state_dict and model the first that
    any key has is opened, and keys lose the prefix of a parallel wrapper."""
    wraps = ("state_dict", "model_state_dict", "model")
    has = entries.agg(*(F.max(F.col("key").startswith(w + ".").cast("int")).alias(w) for w in wraps))
    first = F.coalesce(*(F.when(F.col(w) == 1, F.lit(w + ".")) for w in wraps), F.lit(""))
    rows = entries.join(F.broadcast(has.select(first.alias("_open"))), F.col("key").startswith(F.col("_open")))
    return weight_keys(rows.withColumn("key", F.expr("substring(key, length(_open) + 1)")).drop("_open"))


def required_keys(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted weights; an error when the query runs if one is missing."""
    j = wanted.select("key").join(entries.withColumn("_has", F.lit(True)), "key", "left")
    return j.filter(F.assert_true(F.col("_has"), F.concat(F.lit("no weights for "), F.col("key"))).isNull()).drop("_has")


def slug(name: Column) -> Column:
    """Lower case, runs of white space as one underscore."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def lq_name(path: Column, template: str = "{}") -> Column:
    """The small image's path by a template of the name, with the large one's extension."""
    name, kind = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)?$", 1)
    before, after = template.split("{}")
    return F.concat(F.lit(before), name, F.lit(after), kind)


def pairs_by_name(gt: DataFrame, lq: DataFrame, template: str = "{}") -> DataFrame:
    """Paths of two folders paired by the template; an error when the query runs if a large image has no small one."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    small = lq.select(F.col("path").alias("lq_path"), base.alias("_name"))
    j = gt.select(F.col("path").alias("gt_path"), lq_name(F.col("path"), template).alias("_name")).join(small, "_name", "left")
    return j.filter(F.assert_true(F.col("lq_path").isNotNull(), F.concat(F.lit("no pair for "), F.col("gt_path"))).isNull()).select("gt_path", "lq_path")


def concatenated(parts: DataFrame) -> DataFrame:
    """Frames (video_id, part, frame_idx) numbered through the parts of a video in their order."""
    n = parts.groupBy("video_id", "part").agg((F.max("frame_idx") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("video_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(n.withColumn("_before", F.coalesce(before, F.lit(0))), ["video_id", "part"]).withColumn("frame_no", F.col("_before") + F.col("frame_idx")).drop("_n", "_before")
