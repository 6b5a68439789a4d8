"""Training pairs for enhancement: sharp images, and what two rounds of degradation leave of them.

A round blurs, resizes, adds noise of one of two kinds and goes through the quantisation of JPEG; the
second one ends at the small size with a final low pass, before or after its JPEG step. Targets are
sharpened. An image is a bounded crop, one row with its RGB values 0..1 row by row (``pixels``: height x
width x 3); rows are worked on one at a time and need no shuffle. Random choices come from an item's id and
a seed, so reruns and lost tasks agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.items import PADDED, SIDES, blur_kernel, low_pass


@dataclass(frozen=True)
class Round:
    """Chances and ranges of a round: blur, resize (up, down, not), kind and strength of noise, JPEG quality."""

    blur: float
    resize: tuple[float, float, float]
    scales: tuple[float, float]
    gaussian: float
    sigmas: tuple[float, float]
    poisson_scales: tuple[float, float]
    gray: float
    quality: tuple[float, float]


#: Chances and ranges of both rounds, share of final low passes, and settings of the sharpening (fixed values).
FIRST = Round(1.0, (0.2, 0.7, 0.1), (0.15, 1.5), 0.5, (1, 30), (0.05, 3.0), 0.4, (30, 95))
SECOND = Round(0.8, (0.3, 0.4, 0.3), (0.3, 1.2), 0.5, (1, 25), (0.05, 2.5), 0.4, (30, 95))
FINAL_LOW_PASS = 0.8
SHARP_WEIGHT, SHARP_SIDE, SHARP_ABOVE = 0.5, 51, 10
MODES = ("area", "bilinear", "bicubic")

#: Quantisation tables of the JPEG standard, vertical frequency by row, and its colour transform (fixed values).
LUMA = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
], dtype=float)
CHROMA = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99],
    [18, 21, 26, 66, 99, 99, 99, 99],
    [24, 26, 56, 99, 99, 99, 99, 99],
    [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
], dtype=float)
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
GRAY = np.array([0.2989, 0.587, 0.114])

#: Rows of the orthonormal cosine transform of eight values.
_COSINES = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * i + 1) * u * math.pi / 16) for i in range(8)] for u in range(8)])


def filtered(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Each channel under an odd square kernel; the border is reflected."""
    n = len(kernel) // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(image, ((n, n), (n, n), (0, 0)), mode="reflect"), kernel.shape, axis=(0, 1))
    return np.einsum("hwcij,ij->hwc", view, kernel)


def sharpened(image: np.ndarray, weight: float = SHARP_WEIGHT, side: int = SHARP_SIDE, above: float = SHARP_ABOVE) -> np.ndarray:
    """Unsharp mask where the difference from the blurred image is above a bar (of 255), with soft borders."""
    sigma = 0.3 * ((side - 1) * 0.5 - 1) + 0.8
    line = np.exp(-((np.arange(side) - side // 2) ** 2) / (2 * sigma * sigma))
    line /= line.sum()

    def blurred(a: np.ndarray) -> np.ndarray:
        return filtered_line(filtered_line(a, line, 0), line, 1)

    rest = image - blurred(image)
    soft = blurred((np.abs(rest) * 255 > above).astype(float))
    return soft * np.clip(image + weight * rest, 0, 1) + (1 - soft) * image


def filtered_line(image: np.ndarray, line: np.ndarray, axis: int) -> np.ndarray:
    n = len(line) // 2
    pad = [(n, n) if k == axis else (0, 0) for k in range(image.ndim)]
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="reflect"), len(line), axis=axis) @ line


def weights(n: int, m: int, mode: str, step: float | None = None) -> np.ndarray:
    """What each of m places of a resized line takes from its n places; step: places of the old line to one of
    the new line, where that is not n / m."""
    w, i = np.zeros((m, n)), np.arange(m)
    if mode == "area":
        place = np.arange(n)
        w[(place >= (i * n // m)[:, None]) & (place < (-(-(i + 1) * n // m))[:, None])] = 1
        return w / w.sum(1, keepdims=True)
    at = (i + 0.5) * (step or n / m) - 0.5
    if mode == "bilinear":
        at = np.maximum(at, 0)
    low = np.floor(at).astype(int)
    for k in (0, 1) if mode == "bilinear" else (-1, 0, 1, 2):
        d = np.abs(at - low - k)
        if mode == "bilinear":
            share = 1 - d
        else:
            share = np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, -0.75 * (((d - 5) * d + 8) * d - 4))
        np.add.at(w, (i, np.clip(low + k, 0, n - 1)), share)
    return w


def resized(image: np.ndarray, height: int, width: int, mode: str, step: float | None = None) -> np.ndarray:
    down, along = weights(image.shape[0], height, mode, step), weights(image.shape[1], width, mode, step)
    return np.einsum("ij,jkc,lk->ilc", down, image, along, optimize=True)


def gaussian_noise(image: np.ndarray, sigma: float, gray: bool, rng: np.random.Generator) -> np.ndarray:
    """Normal noise of a deviation (of 255), the same in all channels if gray."""
    return np.clip(image + rng.normal(0, sigma / 255, image.shape[:2] + (1 if gray else image.shape[2],)), 0, 1)


def poisson_noise(image: np.ndarray, scale: float, gray: bool, rng: np.random.Generator) -> np.ndarray:
    """Shot noise: counts of as many levels as the image has values (the next power of two), scaled."""
    base = (image @ GRAY)[..., None] if gray else image
    base = np.round(np.clip(base, 0, 1) * 255) / 255
    levels = 2.0 ** math.ceil(math.log2(len(np.unique(base))))
    return np.clip(image + (rng.poisson(base * levels) / levels - base) * scale, 0, 1)


def jpeg(image: np.ndarray, quality: float) -> np.ndarray:
    """What JPEG of a quality leaves: colour differences at half the size, cosine coefficients of 8 x 8 blocks in
    steps of the tables. Sides are filled up to multiples of 16 by their last pixels."""
    h, w = image.shape[:2]
    factor = max((5000 / quality if quality < 50 else 200 - 2 * quality) / 100, 1e-6)
    planes = np.pad(np.clip(image, 0, 1) * 255, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge") @ YCC.T
    kept = [quantised(planes[..., 0] - 128, LUMA * factor) + 128]
    for k in (1, 2):
        rows, columns = planes.shape[0] // 2, planes.shape[1] // 2
        small = planes[..., k].reshape(rows, 2, columns, 2).mean((1, 3))
        kept.append(quantised(small, CHROMA * factor).repeat(2, 0).repeat(2, 1))
    return np.clip((np.stack(kept, -1) @ np.linalg.inv(YCC).T)[:h, :w] / 255, 0, 1)


def quantised(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A plane (sides multiples of 8) whose coefficients are rounded to multiples of their steps."""
    blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8)
    found = np.einsum("ui,aibj,vj->abuv", _COSINES, blocks, _COSINES, optimize=True)
    found = np.round(found / steps) * steps
    return np.einsum("ui,abuv,vj->aibj", _COSINES, found, _COSINES, optimize=True).reshape(plane.shape)


def _final_kernel(rng: np.random.Generator) -> np.ndarray:
    kernel = np.zeros((PADDED, PADDED))
    kernel[PADDED // 2, PADDED // 2] = 1.0
    if rng.random() < FINAL_LOW_PASS:
        side = int(rng.choice(SIDES))
        kernel = np.pad(low_pass(rng.uniform(math.pi / 3, math.pi), side), (PADDED - side) // 2)
    return kernel


def _resize_scale(r: Round, rng: np.random.Generator) -> float:
    low, high = r.scales
    return {"up": rng.uniform(1, high), "down": rng.uniform(low, 1), "keep": 1.0}[rng.choice(["up", "down", "keep"], p=r.resize)]


def _noisy(image: np.ndarray, r: Round, rng: np.random.Generator) -> np.ndarray:
    gray = rng.random() < r.gray
    if rng.random() < r.gaussian:
        return gaussian_noise(image, rng.uniform(*r.sigmas), gray, rng)
    return poisson_noise(image, rng.uniform(*r.poisson_scales), gray, rng)


def small_version(image: np.ndarray, scale: int, rng: np.random.Generator, first: Round = FIRST, second: Round = SECOND) -> np.ndarray:
    """The degraded image of 1 / scale of the size, in steps of 1 / 255."""
    h, w = image.shape[:2]
    out = filtered(image, blur_kernel(rng)) if rng.random() < first.blur else image
    by = _resize_scale(first, rng)
    out = resized(out, max(1, int(h * by)), max(1, int(w * by)), rng.choice(MODES), 1 / by)
    out = jpeg(_noisy(out, first, rng), rng.uniform(*first.quality))

    if rng.random() < second.blur:
        out = filtered(out, blur_kernel(rng))
    by = _resize_scale(second, rng) / scale
    out = _noisy(resized(out, max(1, int(h * by)), max(1, int(w * by)), rng.choice(MODES)), second, rng)
    low, quality, mode = _final_kernel(rng), rng.uniform(*second.quality), rng.choice(MODES)

    def end(a: np.ndarray) -> np.ndarray:
        return filtered(resized(a, max(1, h // scale), max(1, w // scale), mode), low)

    out = jpeg(end(out), quality) if rng.random() < 0.5 else end(jpeg(out, quality))
    return np.round(np.clip(out, 0, 1) * 255) / 255


def training_pairs(images: DataFrame, scale: int = 4, gt_size: int | None = None, seed: int = 0, first: Round = FIRST, second: Round = SECOND) -> DataFrame:
    """(raster_id, height, width, gt, gt_usm, lq_height, lq_width, lq) of every image (raster_id, height, width, pixels).

    gt_size: both are cut at the same random place to this size and gt_size / scale; an error where an image is
    smaller. Images whose pixels are null are left out; a number of pixels that does not fit is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, h, w, values in zip(batch["raster_id"], batch["height"], batch["width"], batch["pixels"], strict=True):
                if len(values) != h * w * 3:
                    raise ValueError(f"image {i}: {len(values)} values are not {h} x {w} x 3")
                if gt_size and min(h, w) < gt_size:
                    raise ValueError(f"image {i}: {h} x {w} is smaller than {gt_size}")
                rng = np.random.default_rng([seed, int(i) & 0xFFFFFFFFFFFFFFFF])
                gt = np.asarray(values, dtype=float).reshape(h, w, 3)
                usm = sharpened(gt)
                lq = small_version(usm, scale, rng, first, second)
                if gt_size:
                    n = gt_size // scale
                    r, c = int(rng.integers(lq.shape[0] - n + 1)), int(rng.integers(lq.shape[1] - n + 1))
                    lq = lq[r : r + n, c : c + n]
                    gt, usm = (a[r * scale : r * scale + gt_size, c * scale : c * scale + gt_size] for a in (gt, usm))
                yield pd.DataFrame({"raster_id": [i], "height": [gt.shape[0]], "width": [gt.shape[1]], "gt": [gt.ravel()], "gt_usm": [usm.ravel()], "lq_height": [lq.shape[0]], "lq_width": [lq.shape[1]], "lq": [lq.ravel()]})

    rows = images.filter("raster_id is not null and pixels is not null").select(F.col("raster_id").cast("long").alias("raster_id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("pixels").cast("array<double>").alias("pixels"))
    return rows.mapInPandas(run, "raster_id long, height int, width int, gt array<double>, gt_usm array<double>, lq_height int, lq_width int, lq array<double>")
