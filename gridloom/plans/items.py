"""Items of image data sets: crops, flips, normalisation, blur kernels, degradation, pairs.

Random choices come from hashes of an item's id and a seed, so reruns and lost tasks agree.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.tiling import reflect, spread

#: Colour means and deviations that pretrained networks expect (fixed values).
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Sizes of blur kernels, the size they are padded to, families with their shares, and ranges of their parameters.
SIDES, PADDED = tuple(range(7, 22, 2)), 21
FAMILIES = (("iso", 0.45), ("aniso", 0.25), ("generalized_iso", 0.12), ("generalized_aniso", 0.03), ("plateau_iso", 0.12), ("plateau_aniso", 0.03))
SIGMA, BETA_G, BETA_P, SINC = (0.2, 3.0), (0.5, 4.0), (1.0, 2.0), 0.1
#: Kinds of kernels by their formulas, and the shares of the families added up.
LOW_PASS, GAUSS, GENERALIZED, PLATEAU = range(4)
_UP_TO = np.cumsum([p for _, p in FAMILIES])
_UP_TO = (_UP_TO / _UP_TO[-1]).tolist()
#: Items whose kernels are formed and sent together, 5 MB of numbers.
ITEMS_AT_ONCE = 512


def draw(item: str, seed: int, n: Column | int) -> Column:
    """A whole number below n for each item: a multiplicative hash of its id, the same everywhere."""
    mixed = F.pmod(F.pmod(F.col(item).cast("long") + F.lit(seed * 7919 + 1), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
    return F.pmod(F.shiftright(mixed, 8), n if isinstance(n, Column) else F.lit(n)).cast("int")


def crop_plan(images: DataFrame, size: int = 400, seed: int = 0) -> DataFrame:
    """(raster_id, pad_w, pad_h, top, left, flip): pads of smaller images to a size, and where larger ones are cut."""
    return images.select(
        "raster_id", F.greatest(F.lit(size) - F.col("width"), F.lit(0)).alias("pad_w"), F.greatest(F.lit(size) - F.col("height"), F.lit(0)).alias("pad_h"),
        draw("raster_id", seed, F.greatest(F.col("height") - size, F.lit(0)) + 1).alias("top"), draw("raster_id", seed + 1, F.greatest(F.col("width") - size, F.lit(0)) + 1).alias("left"),
        (draw("raster_id", seed + 2, 2) == 1).alias("flip"),
    )


def cropped(pixels: DataFrame, images: DataFrame, size: int = 400, seed: int = 0) -> DataFrame:
    """Images of one size: padded by reflection to the right and below, cut at random places. Pixels that the
    size asks for look up their source, so nothing outside the cut moves."""
    plan = crop_plan(images, size, seed).join(images.select("raster_id", "width", "height"), "raster_id")
    want = plan.withColumn("wr", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("wc", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    want = want.withColumns({"r": reflect(F.col("wr") + F.col("top"), F.col("height")), "c": reflect(F.col("wc") + F.col("left"), F.col("width"))})
    other = [c for c in pixels.columns if c not in ("raster_id", "r", "c")]
    return want.select("raster_id", "wr", "wc", "r", "c").join(pixels, ["raster_id", "r", "c"]).select("raster_id", F.col("wr").alias("r"), F.col("wc").alias("c"), *other)


def paired_plan(pairs: DataFrame, gt_size: int, scale: int, seed: int = 0) -> DataFrame:
    """Where both images of a pair are cut: at the same place, in the pixels of either; an error where sizes do not fit.

    pairs: raster_id, width and height of the large image, lq_width and lq_height of the small one."""
    lq = gt_size // scale
    fits = (F.col("width") == F.col("lq_width") * scale) & (F.col("height") == F.col("lq_height") * scale) & (F.col("lq_width") >= lq) & (F.col("lq_height") >= lq)
    ok = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("sizes of a pair do not fit")).cast("boolean"))
    rows = pairs.filter(ok)
    top, left = draw("raster_id", seed, F.col("lq_height") - lq + 1), draw("raster_id", seed + 1, F.col("lq_width") - lq + 1)
    return rows.select("raster_id", top.alias("lq_top"), left.alias("lq_left"), (top * scale).alias("gt_top"), (left * scale).alias("gt_left"), (draw("raster_id", seed + 2, 2) == 1).alias("flip"), draw("raster_id", seed + 3, 4).alias("turns"))


def turned(pixels: DataFrame, size: int, flip: Column, turns: Column) -> DataFrame:
    """Square images mirrored left to right where flip, then turned by quarters."""
    r, c, last = F.col("r"), F.when(flip, F.lit(size - 1) - F.col("c")).otherwise(F.col("c")), F.lit(size - 1)
    row = F.when(turns == 1, last - c).when(turns == 2, last - r).when(turns == 3, c).otherwise(r)
    column = F.when(turns == 1, r).when(turns == 2, last - c).when(turns == 3, last - r).otherwise(c)
    return pixels.withColumns({"r": row.cast("int"), "c": column.cast("int")})


def normalised(pixels: DataFrame, mean=MEAN, std=STD) -> DataFrame:
    """(v - mean) / deviation of each channel ch."""
    m, s = (F.element_at(F.array(*map(F.lit, x)), (F.col("ch") + 1).cast("int")) for x in (mean, std))
    return pixels.withColumn("v", (F.col("v") - m) / s)


def blur_kernel(rng: np.random.Generator, sinc: float = SINC) -> np.ndarray:
    """A kernel of a random family, side and shape, in the middle of zeros; its sum is 1."""
    return formed([drawn(rng, sinc)])[0]


def drawn(rng: np.random.Generator, sinc: float = SINC) -> tuple[float, ...]:
    """What makes a kernel of a random family: side, kind, exponent (of a low pass its cut), two sigmas, cosine and sine of the turn."""
    side = SIDES[rng.integers(len(SIDES))]
    if rng.random() < sinc:
        return side, LOW_PASS, _between(rng, math.pi / 3 if side < 13 else math.pi / 5, math.pi), 1.0, 1.0, 1.0, 0.0
    family = FAMILIES[bisect.bisect_right(_UP_TO, rng.random())][0]
    sx, turn = _between(rng, *SIGMA), 0.0
    sy = sx
    if family.endswith("aniso"):
        sy, turn = _between(rng, *SIGMA), _between(rng, -math.pi, math.pi)
    kind = PLATEAU if family.startswith("plateau") else GENERALIZED if family.startswith("generalized") else GAUSS
    power = 1.0 if kind == GAUSS else _between(rng, *(BETA_P if kind == PLATEAU else BETA_G))
    return side, kind, power, sx, sy, math.cos(turn), math.sin(turn)


def _between(rng: np.random.Generator, low: float, high: float) -> float:
    """rng.uniform(low, high) without its checks."""
    return low + (high - low) * rng.random()


def formed(shapes: list[tuple[float, ...]]) -> np.ndarray:
    """The kernels of shapes as :func:`drawn`, each in the middle of zeros with the sum 1. Those of one side and kind are
    formed at once."""
    table = np.array(shapes, dtype=float).reshape(-1, 7)
    out = np.zeros((len(table), PADDED, PADDED))
    for side, kind in sorted({(int(a), int(b)) for a, b in table[:, :2]}):
        at = np.flatnonzero((table[:, 0] == side) & (table[:, 1] == kind))
        power, sx, sy, cos, sin = table[at, 2:].T[:, :, None, None]
        if kind == LOW_PASS:
            k = low_passes(power.ravel(), side)
        else:
            y, x = np.indices((side, side)) - side // 2
            u, v = x * cos + y * sin, -x * sin + y * cos
            square = (u / sx) ** 2 + (v / sy) ** 2
            if kind == PLATEAU:
                k = 1 / (1 + square**power)
            else:
                k = np.exp(-0.5 * (square if kind == GAUSS else square**power))
            k /= k.reshape(len(at), -1).sum(1)[:, None, None]
        edge = (PADDED - side) // 2
        out[at, edge : edge + side, edge : edge + side] = k
    return out


def low_pass(cut: float, side: int) -> np.ndarray:
    """A circular low-pass filter: cut * J1(cut * d) / (2 pi d), with the Bessel function as the integral that defines it."""
    return low_passes(np.array([cut]), side)[0]


def low_passes(cuts: np.ndarray, side: int) -> np.ndarray:
    """Low-pass filters of several cuts. J1(x) is the mean of sin(t) sin(x sin(t)) over a quarter turn; it is formed once
    for each distance, at as many places as leave no error at cuts up to pi but that of rounding."""
    y, x = np.indices((side, side)) - side // 2
    d, place = np.unique(np.hypot(x, y).ravel(), return_inverse=True)
    n = side + 8
    t = np.sin((np.arange(n) + 0.5) * math.pi / (2 * n))
    cut = cuts[:, None]
    j1 = np.sin((cut * d)[:, :, None] * t) @ t / n
    k = np.where(d > 0, cut * j1 / (2 * math.pi * np.where(d > 0, d, 1)), cut * cut / (4 * math.pi))[:, place]
    return (k / k.sum(1)[:, None]).reshape(-1, side, side)


def kernels(items: DataFrame, id_col: str = "raster_id", seed: int = 0) -> DataFrame:
    """(item, stage, kernel): three kernels of an item (two blurs, a final low pass or nothing), row by row.

    A small file of items is much work, so items are dealt out to all tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ITEMS_AT_ONCE):
                ids, shapes = batch.column(0).slice(start, ITEMS_AT_ONCE).to_pylist(), []
                for i in ids:
                    rng = np.random.default_rng([seed, i & 0xFFFFFFFF])
                    last = (1, GAUSS, 1.0, 1.0, 1.0, 1.0, 0.0)
                    if rng.random() < 0.8:
                        side = SIDES[rng.integers(len(SIDES))]
                        last = (side, LOW_PASS, _between(rng, math.pi / 3, math.pi), 1.0, 1.0, 1.0, 0.0)
                    shapes += [drawn(rng), drawn(rng), last]
                values = pa.array(formed(shapes).ravel())
                kernel = pa.ListArray.from_arrays(pa.array(np.arange(len(shapes) + 1, dtype="i4") * PADDED**2), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 3)), pa.array(np.tile([1, 2, 3], len(ids)).astype("i4")), kernel], ["item", "stage", "kernel"])

    return spread(items.select(F.col(id_col).cast("long").alias("item"))).mapInArrow(run, "item long, stage int, kernel array<double>")


def degraded(images: DataFrame, scale: int = 4, seed: int = 0) -> DataFrame:
    """(raster_id, lq): images (raster_id, side, pixels: square gray values 0..1 of bounded crops, row by row) made
    small and worse in two rounds: blur, random resize, noise, coarse frequencies (as JPEG leaves them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, side, values in zip(batch["raster_id"], batch["side"], batch["pixels"], strict=True):
                rng = np.random.default_rng([seed, int(i) & 0xFFFFFFFF])
                a = np.asarray(values, dtype=float).reshape(side, side)
                for stage in (1, 2):
                    a = _blurred(a, blur_kernel(rng))
                    n = side // scale if stage == 2 else max(side // scale, int(side * rng.uniform(0.3, 1.5)))
                    a = _resized(a, n)
                    a = np.clip(a + rng.normal(0, rng.uniform(1, 25) / 255, a.shape), 0, 1)
                    a = _coarse(a, rng.uniform(30, 95))
                out.append((i, np.round(np.clip(a, 0, 1) * 255).ravel() / 255))
            yield pd.DataFrame(out, columns=["raster_id", "lq"])

    return images.select(F.col("raster_id").cast("long").alias("raster_id"), "side", "pixels").mapInPandas(run, "raster_id long, lq array<double>")


def _blurred(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    n = len(k) // 2
    p = np.pad(a, n, mode="symmetric") if min(a.shape) < n + 1 else np.pad(a, n, mode="reflect")
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(p, k.shape), k)


def _resized(a: np.ndarray, n: int) -> np.ndarray:
    """Bilinear, to n pixels a side."""

    def weights(size: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.minimum(at.astype(int), max(size - 2, 0))
        w = np.zeros((n, size))
        w[np.arange(n), low] += 1 - (at - low)
        w[np.arange(n), np.minimum(low + 1, size - 1)] += at - low
        return w

    return weights(a.shape[0]) @ a @ weights(a.shape[1]).T


def _coarse(a: np.ndarray, quality: float) -> np.ndarray:
    """Cosine coefficients of 8 x 8 blocks rounded to steps that grow with the frequency."""
    h, w = a.shape
    p = np.pad(a, ((0, -h % 8), (0, -w % 8)), mode="edge") * 255 - 128
    i = np.arange(8)
    base = np.sqrt(np.where(i == 0, 1, 2) / 8)[:, None] * np.cos((2 * i[None, :] + 1) * i[:, None] * np.pi / 16)
    blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8)
    c = np.einsum("ui,aibj,vj->aubv", base, blocks, base)
    step = (16 + 6 * (i[:, None] + i[None, :])) * ((5000 / quality if quality < 50 else 200 - 2 * quality) / 100) + 1e-3
    c = np.round(c / step[None, :, None, :]) * step[None, :, None, :]
    back = np.einsum("ui,aubv,vj->aibj", base, c, base).reshape(p.shape)
    return np.clip((back[:h, :w] + 128) / 255, 0, 1)


def pool_plan(batches: DataFrame, pool: int, seed: int = 0) -> DataFrame:
    """(raster_id, out): which earlier or later item leaves the pool for each one that enters: items (with a place
    ``idx``) are shuffled inside windows of the pool's size, so a batch mixes items of several batches."""
    block = F.floor(F.col("idx") / pool)
    w = Window.partitionBy("_block")
    rows = batches.withColumns({"_block": block, "_key": F.xxhash64("raster_id", F.lit(seed))})
    place = rows.withColumns({"_in": F.row_number().over(w.orderBy("idx")), "_out": F.row_number().over(w.orderBy("_key", "idx"))})
    return place.join(place.select("_block", F.col("_out").alias("_in"), F.col("raster_id").alias("out")), ["_block", "_in"]).select("idx", "raster_id", "out")
