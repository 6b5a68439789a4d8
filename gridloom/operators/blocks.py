"""Array kernels over blocks of a raster with a halo, for what expressions cannot say.

A block's pixels and its halo are one group of bounded size (``(block + 2 * halo)^2`` pixels), so a
raster of any size is dealt to all tasks and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.tiling import halo_tiles


def dense(part: pd.DataFrame, value: str | None, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Array of a group's pixels, which of its places hold one, and the row and column of its corner."""
    r, c = part["r"].to_numpy(), part["c"].to_numpy()
    r0, c0 = int(r.min()), int(c.min())
    shape = (int(r.max()) - r0 + 1, int(c.max()) - c0 + 1)
    values, present = np.full(shape, fill), np.zeros(shape, dtype=bool)
    values[r - r0, c - c0] = part[value].to_numpy() if value else 1.0
    present[r - r0, c - c0] = True
    return values, present, r0, c0


def by_block(raster: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 256, halo: int = 16, mirror: bool = False) -> DataFrame:
    """v of every pixel from kernel(values, present) over its block and halo.

    mirror: where the scene ends inside the halo, values are reflected (without the border)."""

    def run(key, part):
        values, present, r0, c0 = dense(part, "v")
        pad = [(0, 0), (0, 0)]
        if mirror:
            low_r, low_c = max(0, int(key[1]) * block - halo), max(0, int(key[2]) * block - halo)
            want = [(halo - (int(key[1]) * block - low_r) if r0 <= low_r else 0, halo), (halo - (int(key[2]) * block - low_c) if c0 <= low_c else 0, halo)]
            pad = [(min(a, n - 1), min(b, n - 1)) for (a, b), n in zip(want, values.shape, strict=True)]
            values, present = np.pad(values, pad, mode="reflect"), np.pad(present, pad)
        out = kernel(values, present)
        inner = part[part["inner"]]
        got = out[inner["r"].to_numpy() - r0 + pad[0][0], inner["c"].to_numpy() - c0 + pad[1][0]]
        return pd.DataFrame({"raster_id": inner["raster_id"], "r": inner["r"], "c": inner["c"], "v": got})

    return halo_tiles(raster.select("raster_id", "r", "c", F.col("v").cast("double").alias("v")), block, halo).groupBy("raster_id", "tile_r", "tile_c").applyInPandas(run, "raster_id long, r int, c int, v double")
