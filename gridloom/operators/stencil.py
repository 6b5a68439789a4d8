"""Filters over pixel neighbourhoods of dense rasters.

A kernel is an array of offsets with weights. Every pixel sends its value to the places that need it
(one explode, one aggregation by place: the shuffle carries partial sums), and borders are mirrored
by sending to the mirrored places as well. Separable kernels run one axis at a time.
"""

from __future__ import annotations

import functools
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.blocks import by_block

KEYS = ["raster_id", "r", "c"]


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    """Weights of a normalised Gaussian; four sigma to each side unless a radius is given."""
    n = radius if radius is not None else int(4 * sigma + 0.5)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-n, n + 1)]
    return [x / sum(w) for x in w]


def _along(raster: DataFrame, scenes: DataFrame, axis: str, size: str, weights: list[float], mirror_edge: bool) -> DataFrame:
    """Weighted sums along an axis. mirror_edge: the border pixel is repeated when mirroring."""
    n = len(weights) // 2
    kernel = F.array(*(F.struct(F.lit(k - n).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)))
    sized = raster.join(scenes.select("raster_id", size), "raster_id")
    # the pixel at i and its mirror images outside 0..size-1
    i, m = F.col(axis), F.col(size)
    images = F.array(i, *((-1 - i, 2 * m - 1 - i) if mirror_edge else (-i, 2 * (m - 1) - i)))
    images = F.array_distinct(images)
    seen = sized.withColumn("_i", F.explode(images)).filter((F.col("_i") >= -n) & (F.col("_i") < m + n)).withColumn("_k", F.explode(kernel))
    sent = seen.withColumn(axis, (F.col("_i") + F.col("_k.d")).cast("int")).filter((F.col(axis) >= 0) & (F.col(axis) < m))
    return sent.groupBy(*KEYS).agg(F.sum(F.col("v") * F.col("_k.w")).alias("v"))


def gaussian(raster: DataFrame, scenes: DataFrame, sigma: float, radius: int | None = None, mirror_edge: bool = False) -> DataFrame:
    """Gaussian smoothing of v, rows first."""
    w = gaussian_kernel(sigma, radius)
    return _along(_along(raster.select(*KEYS, "v"), scenes, "r", "height", w, mirror_edge), scenes, "c", "width", w, mirror_edge)


def box_mean(raster: DataFrame, scenes: DataFrame, radius: int = 1) -> DataFrame:
    """Mean over a square, the border repeated (radius 1) or mirrored with its edge."""
    w = [1.0 / (2 * radius + 1)] * (2 * radius + 1)
    return _along(_along(raster.select(*KEYS, "v"), scenes, "r", "height", w, True), scenes, "c", "width", w, True)


def unsharp(raster: DataFrame, scenes: DataFrame, sigma: float = 2.0, amount: float = 1.4) -> DataFrame:
    """amount * v - (amount - 1) * smoothed."""
    soft = gaussian(raster, scenes, sigma).withColumnRenamed("v", "_s")
    return raster.join(soft, KEYS).select(*KEYS, (F.lit(amount) * F.col("v") - F.lit(amount - 1) * F.col("_s")).alias("v"))


def ribbon_kernel(width: float, angle: float) -> np.ndarray:
    """A line filter by distance from a line through its middle: 1 in a ribbon, -0.5 on its flanks of the
    same width, brought to mean 0 and absolute sum 1; its side is seven widths, made odd."""
    side = int(width * 7) | 1
    y, x = np.indices((side, side)) - side // 2
    away = np.abs(y * math.cos(math.radians(angle)) - x * math.sin(math.radians(angle)))
    k = np.select([away <= width / 2, away <= width * 1.5], [1.0, -0.5])
    k -= k.mean()
    return k / (np.abs(k).sum() + 1e-6)


@functools.lru_cache(maxsize=4)
def _ribbon_spectra(widths: tuple[float, ...], orientations: int, shape: tuple[int, int]) -> np.ndarray:
    """Transforms of all kernels, centred on the first pixel, for blocks of a shape; made once in a worker."""
    out = []
    for w in widths:
        for i in range(orientations):
            k = ribbon_kernel(w, 180.0 * i / orientations)[::-1, ::-1]
            at = np.arange(len(k)) - len(k) // 2
            spread = np.zeros(shape)
            np.add.at(spread, (at[:, None] % shape[0], at[None, :] % shape[1]), k)
            out.append(np.fft.rfft2(spread))
    return np.array(out)


def ribbon_energy(raster: DataFrame, widths=(2.5, 4.0), orientations: int = 16, block: int = 256) -> DataFrame:
    """Highest response of each pixel over line filters of all widths and directions, 0 at least.

    Large kernels are applied to blocks with a halo, by Fourier transforms in Arrow batches; pixels
    beyond the scene are mirrored."""
    widths = tuple(widths)
    halo = max(int(w * 7) | 1 for w in widths) // 2

    def energy(values: np.ndarray, present: np.ndarray) -> np.ndarray:
        best, own = np.zeros_like(values), np.fft.rfft2(values)
        for spectrum in _ribbon_spectra(widths, orientations, values.shape):
            best = np.maximum(best, np.fft.irfft2(own * spectrum, s=values.shape))
        return best

    return by_block(raster, energy, block, halo, mirror=True)


def neighbours(raster: DataFrame) -> DataFrame:
    """Values of the eight neighbours as columns named by direction; null where there is no pixel. A corner
    is also null where the pixel between it and this one's row is missing."""
    across = Window.partitionBy("raster_id", "r").orderBy("c")
    down = Window.partitionBy("raster_id", "c").orderBy("r")
    row = raster.select(*KEYS, "v").withColumns({"v_w": F.first("v").over(across.rangeBetween(-1, -1)), "v_e": F.first("v").over(across.rangeBetween(1, 1))})
    names = {"v": ("v_n", "v_s"), "v_w": ("v_nw", "v_sw"), "v_e": ("v_ne", "v_se")}
    return row.withColumns({n: F.first(x).over(down.rangeBetween(d, d)) for x, pair in names.items() for n, d in zip(pair, (-1, 1), strict=True)})


def gradient(raster: DataFrame) -> DataFrame:
    """Sobel gradients gx and gy, their magnitude, and the direction in 0..180 degrees, off the border."""
    n = neighbours(raster).na.drop(subset=["v_n", "v_s", "v_w", "v_e", "v_nw", "v_ne", "v_sw", "v_se"])
    col = F.col
    gx = (col("v_ne") + 2 * col("v_e") + col("v_se")) - (col("v_nw") + 2 * col("v_w") + col("v_sw"))
    gy = (col("v_sw") + 2 * col("v_s") + col("v_se")) - (col("v_nw") + 2 * col("v_n") + col("v_ne"))
    g = n.withColumns({"gx": gx, "gy": gy})
    angle = F.degrees(F.atan2("gy", "gx"))
    return g.withColumns({"magnitude": F.sqrt(col("gx") * col("gx") + col("gy") * col("gy")), "direction": F.when(angle < 0, angle + 180).otherwise(angle)})


def ridges(raster: DataFrame, seed: float = 0.15, extend: float = 0.05, flat: float = 0.05) -> DataFrame:
    """Pixels that are a maximum along the gradient (in four sectors), or high and flat."""
    g = gradient(raster).filter(F.col("v") >= extend)
    d, v = F.col("direction"), F.col("v")
    ends = (
        F.when((d < 22.5) | (d >= 157.5), F.greatest("v_e", "v_w"))
        .when(d < 67.5, F.greatest("v_sw", "v_ne"))
        .when(d < 112.5, F.greatest("v_s", "v_n"))
        .otherwise(F.greatest("v_nw", "v_se"))
    )
    return g.filter((v >= ends) | ((v >= seed) & (F.col("magnitude") < flat))).select(*KEYS, "v")


def edges(raster: DataFrame, low: float = 30.0, high: float = 90.0) -> DataFrame:
    """Edges: maxima of the gradient along its direction, joined to strong ones through weak ones."""
    from gridloom.operators.components import label

    g = gradient(raster).select(*KEYS, (F.abs("gx") + F.abs("gy")).alias("v"), "direction")
    n = neighbours(g).join(g.select(*KEYS, "direction"), KEYS)
    d, zero = F.col("direction"), F.lit(0.0)

    def pair(a: str, b: str) -> Column:
        return F.greatest(F.coalesce(a, zero), F.coalesce(b, zero))

    ends = F.when((d < 22.5) | (d >= 157.5), pair("v_e", "v_w")).when(d < 67.5, pair("v_se", "v_nw")).when(d < 112.5, pair("v_s", "v_n")).otherwise(pair("v_sw", "v_ne"))
    thin = n.filter((F.col("v") >= ends) & (F.col("v") > low)).select(*KEYS, "v")
    found = label(thin)
    strong = found.join(thin.filter(F.col("v") > high), KEYS, "left_semi").select("raster_id", "label").distinct()
    return found.join(strong, ["raster_id", "label"], "left_semi").select(*KEYS)


def neighbour_count(mask: DataFrame) -> DataFrame:
    """Foreground pixels with the number n of their eight neighbours that are foreground."""
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)))
    near = mask.withColumn("_d", F.explode(offsets)).select("raster_id", (F.col("r") + F.col("_d.dr")).cast("int").alias("r"), (F.col("c") + F.col("_d.dc")).cast("int").alias("c"))
    counts = near.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return mask.select(*KEYS).join(counts, KEYS, "left").fillna(0, ["n"])


def endpoints(mask: DataFrame) -> DataFrame:
    """Pixels with exactly one foreground neighbour."""
    return neighbour_count(mask).filter("n = 1").select(*KEYS)


def median(raster: DataFrame, scenes: DataFrame, radius: int = 3, block: int = 256) -> DataFrame:
    """Median over a square, the border pixels repeated; places of the square without a pixel are left out."""

    def kernel(values: np.ndarray, present: np.ndarray) -> np.ndarray:
        side = 2 * radius + 1
        known = np.pad(np.where(present, values, np.nan), radius, mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(known, (side, side))
        # a few rows at a time: side * side copies of a row are held at once
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            return np.stack([np.nanmedian(views[i].reshape(views.shape[1], -1), axis=1) for i in range(len(views))])

    return by_block(raster, kernel, block, radius)


def frangi(raster: DataFrame, scenes: DataFrame, sigmas=(1.2, 2.0, 3.2, 4.8), bright: bool = True, beta: float = 0.5) -> DataFrame:
    """Ridge strength from the eigenvalues of the Hessian, the highest over the scales.

    The structure constant of a scale is half the largest Hessian norm of the raster."""
    best = None
    for sigma in sigmas:
        soft = gaussian(raster, scenes, sigma, mirror_edge=True)
        n = neighbours(soft).fillna(0.0)
        col = F.col
        s2 = F.lit(sigma * sigma)
        n = n.withColumns({"hrr": s2 * (col("v_s") - 2 * col("v") + col("v_n")), "hcc": s2 * (col("v_e") - 2 * col("v") + col("v_w")), "hrc": s2 * (col("v_se") - col("v_sw") - col("v_ne") + col("v_nw")) / 4})
        inner = n.join(scenes.select("raster_id", "width", "height"), "raster_id").filter("r > 0 and c > 0 and r < height - 1 and c < width - 1")
        half, root = (col("hrr") + col("hcc")) / 2, F.sqrt(((col("hrr") - col("hcc")) / 2) ** 2 + col("hrc") ** 2)
        e = inner.withColumns({"_p": half + root, "_m": half - root})
        small = F.when(F.abs("_p") < F.abs("_m"), col("_p")).otherwise(col("_m"))
        large = F.when(F.abs("_p") < F.abs("_m"), col("_m")).otherwise(col("_p"))
        e = e.select(*KEYS, small.alias("l1"), large.alias("l2")).withColumn("_s", F.sqrt(col("l1") ** 2 + col("l2") ** 2))
        top = e.groupBy("raster_id").agg((F.max("_s") / 2).alias("_g"))
        kind = col("l2") < 0 if bright else col("l2") > 0
        value = F.exp(-((col("l1") / col("l2")) ** 2) / (2 * beta * beta)) * (F.lit(1.0) - F.exp(-(col("_s") ** 2) / (2 * col("_g") ** 2)))
        one = e.join(top, "raster_id").select(*KEYS, F.when(kind & (col("_g") > 0), value).otherwise(F.lit(0.0)).alias("v"))
        best = one if best is None else best.unionByName(one)
    return best.groupBy(*KEYS).agg(F.max("v").alias("v"))


def clahe(raster: DataFrame, scenes: DataFrame, clip_limit: float = 2.0, grid: int = 8) -> DataFrame:
    """Contrast-limited equalisation of whole numbers 0..255 on a grid of tiles.

    A tile's histogram has 256 bins whatever its size; counts above the limit are spread over all
    bins, and a pixel's value is interpolated between the mappings of the four tiles around it."""
    s = raster.join(scenes.select("raster_id", "width", "height"), "raster_id")
    th, tw = F.col("height") / F.lit(float(grid)), F.col("width") / F.lit(float(grid))
    level = F.least(F.greatest(F.floor("v"), F.lit(0)), F.lit(255)).cast("int")
    s = s.withColumns({"bin": level, "fr": (F.col("r") + 0.5) / th - 0.5, "fc": (F.col("c") + 0.5) / tw - 0.5})
    s = s.withColumns({"tr": F.least(F.floor(F.col("r") / th), F.lit(grid - 1)).cast("int"), "tc": F.least(F.floor(F.col("c") / tw), F.lit(grid - 1)).cast("int")})
    counts = s.groupBy("raster_id", "tr", "tc", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("raster_id", "tr", "tc").agg(F.sum("n").alias("area"))
    bins = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    full = bins.join(counts, ["raster_id", "tr", "tc", "bin"], "left").fillna(0, ["n"])
    limit = F.greatest(F.floor(F.lit(clip_limit) * F.col("area") / 256.0), F.lit(1))
    tile = Window.partitionBy("raster_id", "tr", "tc")
    full = full.withColumn("over", F.sum(F.greatest(F.col("n") - limit, F.lit(0))).over(tile))
    full = full.withColumn("n", F.least(F.col("n").cast("double"), limit.cast("double")) + F.col("over") / 256.0)
    lut = full.withColumn("y", F.sum("n").over(tile.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) * 255.0 / F.col("area")).select("raster_id", "tr", "tc", "bin", "y")

    def near(f: str) -> Column:
        low = F.floor(f)
        w = F.col(f) - low
        last = F.lit(grid - 1)
        a, b = F.greatest(low, F.lit(0)), F.least(low + 1, last)
        return F.array(F.struct(F.least(a, last).cast("int").alias("t"), (1 - w).alias("w")), F.struct(F.greatest(b, F.lit(0)).cast("int").alias("t"), w.alias("w")))

    four = s.select(*KEYS, "bin", F.explode(near("fr")).alias("a"), near("fc").alias("_b")).select(*KEYS, "bin", "a", F.explode("_b").alias("b"))
    four = four.select(*KEYS, "bin", F.col("a.t").alias("tr"), F.col("b.t").alias("tc"), (F.col("a.w") * F.col("b.w")).alias("w"))
    return four.join(lut, ["raster_id", "tr", "tc", "bin"]).groupBy(*KEYS).agg(F.round(F.sum(F.col("y") * F.col("w"))).alias("v"))
