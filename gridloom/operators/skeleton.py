"""Thinning to lines one pixel wide, line ends, and bridging of gaps between them.

Thinning deletes border pixels in two alternating sub-steps until nothing changes (Zhang and Suen,
1984). A step looks one pixel around, so ``STEPS`` full steps of a block are exact with a halo of
twice as many pixels; passes over all blocks repeat while a block still changes in its last step,
which happens only for roads wider than about ``2 * STEPS`` pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blocks import dense
from gridloom.operators.mask import KEYS, union
from gridloom.operators.stencil import endpoints
from gridloom.operators.tiling import halo_tiles
from gridloom.session import written

BLOCK, STEPS = 512, 16


def _around(a: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of every pixel, clockwise from the one above."""
    p = np.pad(a, 1)
    return [p[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]] for dr, dc in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thin_step(a: np.ndarray) -> tuple[np.ndarray, bool]:
    """One full step (two sub-steps) on a boolean array."""
    changed = False
    for first in (True, False):
        n = _around(a)
        count = sum(x.astype(np.int8) for x in n)
        turns = sum((~n[k] & n[(k + 1) % 8]).astype(np.int8) for k in range(8))
        up, right, down, left = n[0], n[2], n[4], n[6]
        free = ~(up & right & down) & ~(right & down & left) if first else ~(up & right & left) & ~(up & down & left)
        gone = a & (count >= 2) & (count <= 6) & (turns == 1) & free
        if gone.any():
            changed = True
            a = a & ~gone
    return a, changed


def thin(a: np.ndarray) -> np.ndarray:
    changed = True
    while changed:
        a, changed = thin_step(a)
    return a


def _thin_block(key, part):
    values, present, r0, c0 = dense(part, None)
    a, changed, n = present, True, 0
    while changed and n < STEPS:
        a, changed = thin_step(a)
        n += 1
    inner = part[part["inner"]]
    kept = a[inner["r"].to_numpy() - r0, inner["c"].to_numpy() - c0]
    out = inner[kept][["raster_id", "r", "c"]]
    return out.assign(open=changed)


def skeleton(mask: DataFrame) -> DataFrame:
    """The skeleton of each raster of a mask."""
    now = mask.select(*KEYS)
    while True:
        tiles = halo_tiles(now, BLOCK, 2 * STEPS)
        done = written(tiles.groupBy("raster_id", "tile_r", "tile_c").applyInPandas(_thin_block, "raster_id long, r int, c int, open boolean"), "thin")
        now = done.select(*KEYS)
        if done.filter("open").isEmpty():
            return now


def centerlines(prob: DataFrame, t: float = 0.35, area: int = 20) -> DataFrame:
    """Threshold, components that are large enough, skeleton."""
    from gridloom.operators.components import area_filter, label, stats, write_back
    from gridloom.operators.mask import threshold

    labels = label(threshold(prob, t))
    return skeleton(write_back(labels, area_filter(stats(labels), area)))


DEPTH = 8


def _tangents(key, part):
    """Outward direction of each line end: from where a walk of up to DEPTH steps along the line leads."""
    pixels = set(zip(part["r"].tolist(), part["c"].tolist(), strict=True))
    rows = []
    for raster_id, r, c in part[part["inner"] & part["end"]][["raster_id", "r", "c"]].itertuples(index=False):
        at, seen = (r, c), {(r, c)}
        for _ in range(DEPTH):
            near = [(at[0] + i, at[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (at[0] + i, at[1] + j) in pixels and (at[0] + i, at[1] + j) not in seen]
            if not near:
                break
            at = near[0]
            seen.add(at)
        dr, dc = r - at[0], c - at[1]
        norm = math.hypot(dr, dc)
        if norm > 0:
            rows.append((raster_id, r, c, dr / (norm + 1e-6), dc / (norm + 1e-6)))
    return pd.DataFrame(rows, columns=["raster_id", "r", "c", "tr", "tc"])


def tangents(skel: DataFrame) -> DataFrame:
    """(raster_id, r, c, tr, tc) of the line ends of a skeleton that have a direction."""
    ends = endpoints(skel).withColumn("end", F.lit(True))
    marked = skel.select(*KEYS).join(ends, KEYS, "left").fillna(False, ["end"])
    tiles = halo_tiles(marked, BLOCK, DEPTH + 1)
    return tiles.groupBy("raster_id", "tile_r", "tile_c").applyInPandas(_tangents, "raster_id long, r int, c int, tr double, tc double")


def bridge_candidates(ends: DataFrame, prob: DataFrame, gap: float = 28.0, angle: float = 28.0, least: float = 0.03) -> DataFrame:
    """For each line end the nearest later one (in row-major order) that lies ahead, looks back, and has
    no barren ground between: pairs come from an equality join on cells as large as the gap."""
    cell = int(math.ceil(gap))
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    a = ends.withColumns({"cr": F.floor(F.col("r") / cell), "cc": F.floor(F.col("c") / cell)})
    a = a.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"cr": F.col("cr") + F.col("_i"), "cc": F.col("cc") + F.col("_j")}).drop("_i", "_j")
    b = ends.select("raster_id", F.floor(F.col("r") / cell).alias("cr"), F.floor(F.col("c") / cell).alias("cc"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("tr").alias("ur"), F.col("tc").alias("uc"))
    p = a.join(b, ["raster_id", "cr", "cc"]).filter("r2 > r or (r2 = r and c2 > c)")
    dr, dc = (F.col("r2") - F.col("r")).cast("double"), (F.col("c2") - F.col("c")).cast("double")
    p = p.withColumn("dist", F.sqrt(dr * dr + dc * dc)).filter((F.col("dist") >= 2) & (F.col("dist") <= gap))
    bar = math.cos(math.radians(angle))
    ahead = (F.col("tr") * dr + F.col("tc") * dc) / F.col("dist") >= bar
    back = -(F.col("ur") * dr + F.col("uc") * dc) / F.col("dist") >= bar
    p = p.filter(ahead & back)
    probes = F.array(*(F.struct((F.col("r") + F.floor(dr * t + F.when(dr < 0, 1 - 1e-9).otherwise(0.0))).cast("int").alias("pr"), (F.col("c") + F.floor(dc * t + F.when(dc < 0, 1 - 1e-9).otherwise(0.0))).cast("int").alias("pc")) for t in (0.25, 0.5, 0.75)))
    asked = p.select("raster_id", "r", "c", "r2", "c2", "dist", F.explode(probes).alias("_p"))
    values = prob.select("raster_id", F.col("r").alias("pr"), F.col("c").alias("pc"), "p")
    asked = asked.withColumns({"pr": F.col("_p.pr"), "pc": F.col("_p.pc")}).join(values, ["raster_id", "pr", "pc"], "left")
    ok = asked.groupBy("raster_id", "r", "c", "r2", "c2", "dist").agg(F.min("p").alias("_low")).filter(F.coalesce(F.col("_low") >= least, F.lit(True)))
    best = ok.groupBy("raster_id", "r", "c").agg(F.min(F.struct("dist", "r2", "c2")).alias("_b"))
    return best.select("raster_id", "r", "c", F.col("_b.r2").alias("r2"), F.col("_b.c2").alias("c2"), F.col("_b.dist").alias("dist"))


def draw_lines(pairs: DataFrame) -> DataFrame:
    """Pixels of the straight lines between (r, c) and (r2, c2), one for each step of the longer side."""
    dr, dc = F.col("r2") - F.col("r"), F.col("c2") - F.col("c")
    n = F.greatest(F.abs(dr), F.abs(dc))
    rows = pairs.withColumns({"_n": n, "_dr": dr, "_dc": dc}).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))

    def at(start: str, d: str):
        return (F.col(start) + F.floor(F.col(d) * F.col("_k") / F.greatest(F.col("_n"), F.lit(1)) + 0.5)).cast("int")

    return rows.select("raster_id", at("r", "_dr").alias("r"), at("c", "_dc").alias("c")).distinct()


def bridged(skel: DataFrame, prob: DataFrame, gap: float = 28.0, angle: float = 28.0) -> DataFrame:
    """The skeleton with its gaps bridged, thinned again."""
    pairs = bridge_candidates(tangents(skel), prob, gap, angle)
    return skeleton(union(skel, draw_lines(pairs)))
