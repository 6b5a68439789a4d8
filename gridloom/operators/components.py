"""Connected components of masks, their statistics and the filters built on them.

Pixels are labelled inside square blocks by a small union-find in Arrow batches; labels that touch
across block seams become edges of a graph that is far smaller than the mask, whose components are
found by star joins over the cluster. A label is the smallest linear index ``r * stride + c`` of its
component, so it depends on neither blocks nor partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import components as graph_components
from gridloom.operators.mask import KEYS
from gridloom.session import written

BLOCK = 512
#: Columns of a raster at most: labels are r * STRIDE + c, below 2^40 for each raster.
STRIDE = 1 << 20


def _label_block(r: np.ndarray, c: np.ndarray, eight: bool) -> np.ndarray:
    """Smallest linear index of each pixel's component inside one block."""
    index = r.astype(np.int64) * STRIDE + c
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    parent = np.arange(len(sorted_))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    steps = ((0, -1), (-1, 0), (-1, -1), (-1, 1)) if eight else ((0, -1), (-1, 0))
    for dr, dc in steps:
        near = sorted_ + dr * STRIDE + dc
        at = np.searchsorted(sorted_, near)
        hit = np.flatnonzero((at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] == near))
        for i, j in zip(hit.tolist(), at[hit].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = np.empty(len(index), dtype=np.int64)
    out[order] = sorted_[[root(i) for i in range(len(parent))]]
    return out


def _label(eight: bool):
    def run(key, part):
        return part.assign(label=_label_block(part["r"].to_numpy(), part["c"].to_numpy(), eight))[["raster_id", "r", "c", "label"]]

    return run


def label(mask: DataFrame, eight: bool = True, block: int = BLOCK) -> DataFrame:
    """(raster_id, r, c, label) of every foreground pixel, with 8 or 4 neighbours."""
    blocks = mask.select(*KEYS).groupBy("raster_id", F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc"))
    local = written(blocks.applyInPandas(_label(eight), "raster_id long, r int, c int, label long"), "labels")
    # pixels on the first row or column of a block, against those across the seam
    r0, c0 = F.col("r") % block == 0, F.col("c") % block == 0
    seam_r, seam_c = (F.col("r") % block == block - 1), (F.col("c") % block == block - 1)
    steps = [(-1, 0, r0), (0, -1, c0)] + ([(-1, -1, r0 | c0), (-1, 1, r0 | seam_c)] if eight else [])
    offsets = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"))) for a, b, on in steps)))
    first = local.filter(r0 | c0 | seam_c).withColumn("_d", F.explode(offsets))
    first = first.select("raster_id", (F.col("r") + F.col("_d.dr")).cast("int").alias("r"), (F.col("c") + F.col("_d.dc")).cast("int").alias("c"), F.col("label").alias("other"))
    last = local.filter(seam_r | seam_c | r0 | c0)
    pairs = first.join(last, KEYS).filter("label <> other").select("raster_id", "label", "other").distinct()
    # rasters are kept apart by a node number for each (raster, label) on a seam
    node = F.struct("raster_id", "label")
    edges = pairs.select(node.alias("a"), F.struct("raster_id", F.col("other").alias("label")).alias("b"))
    joined = graph_components(edges)
    final = joined.select(F.col("node.raster_id").alias("raster_id"), F.col("node.label").alias("label"), F.col("component.label").alias("lowest"))
    return local.join(final, ["raster_id", "label"], "left").select("raster_id", "r", "c", F.coalesce("lowest", "label").alias("label"))


def stats(labels: DataFrame) -> DataFrame:
    """Area, bounding box, diagonal and aspect of every component."""
    s = labels.groupBy("raster_id", "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("c").alias("x"), F.min("r").alias("y"),
        (F.max("c") - F.min("c") + 1).alias("bbox_w"), (F.max("r") - F.min("r") + 1).alias("bbox_h"),
    )
    w, h = F.col("bbox_w").cast("double"), F.col("bbox_h").cast("double")
    return s.withColumns({"diagonal": F.sqrt(w * w + h * h), "aspect": F.greatest(w, h) / (F.least(w, h) + F.lit(1e-6))})


#: The shape filters in use: least area, and least diagonal or least aspect.
SHAPES = {
    "default": (20, 12.0, 1.6), "command": (15, 12.0, 1.6), "compact": (30, 25.0, 2.0), "pretrained": (35, 25.0, 2.0),
    "ribbon": (25, 20.0, 2.5), "dense": (20, 15.0, 1.8), "thin": (15, 12.0, 1.6), "complete": (12, 10.0, 1.5),
}


def shape_filter(found: DataFrame, area: int = 20, diagonal: float = 12.0, aspect: float = 1.6) -> DataFrame:
    """Components that are large enough and long or narrow enough."""
    return found.filter((F.col("area") >= area) & ((F.col("diagonal") >= diagonal) | (F.col("aspect") >= aspect)))


def area_and_diagonal(found: DataFrame, area: int = 12, diagonal: float = 8.0) -> DataFrame:
    return found.filter((F.col("area") >= area) & (F.col("diagonal") >= diagonal))


def area_filter(found: DataFrame, area: int = 20) -> DataFrame:
    return found.filter(F.col("area") >= area)


def write_back(labels: DataFrame, kept: DataFrame) -> DataFrame:
    """The pixels of the components that are kept."""
    return labels.join(kept.select("raster_id", "label"), ["raster_id", "label"], "left_semi").select(*KEYS)


def hysteresis(prob: DataFrame, low: float = 0.15, high: float = 0.30) -> DataFrame:
    """Pixels of the components at the low threshold that hold a pixel at the high one."""
    found = label(prob.filter(F.col("p") >= low))
    seeds = prob.filter(F.col("p") >= high).select(*KEYS)
    strong = found.join(seeds, KEYS, "left_semi").select("raster_id", "label").distinct()
    return found.join(strong, ["raster_id", "label"], "left_semi")


def branch_hysteresis(prob: DataFrame, low: float = 0.05, high: float = 0.15, least: int = 8) -> DataFrame:
    """Components at the low threshold that reach the high one and have enough pixels, with their maximum."""
    found = label(prob.filter(F.col("p") >= low)).join(prob, KEYS)
    return found.groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("area"), F.max("p").alias("max_p")).filter((F.col("max_p") >= high) & (F.col("area") >= least))
