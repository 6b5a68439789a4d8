"""Rasters as tables of tiles: a row is a tile with its values as bytes.

A tile table is bucketed by its place, so tiles stay where they are. A neighbourhood operator sends
each tile's edge strips to the tiles around it, joins them on there, and runs a kernel over the tile
and its halo; the only shuffle is that of the strips. A chain of small steps (closing, then opening)
is one kernel with the halo of all of them. Tiles of a mask without any pixel need no row: a strip
that arrives where no tile is makes one.

Components are labelled in each tile and joined over seams by a graph of edge pixels; distances need
one summary of each tile for its column of tiles, then meet along a row of tiles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import STRIDE, _label_block
from gridloom.operators.distance import _envelope
from gridloom.operators.graph import components as graph_components
from gridloom.session import scratch_path

PLACE = ["raster_id", "tr", "tc"]
SCHEMA = "raster_id long, tr int, tc int, height int, width int, data binary"
TILE = 256
#: Where a strip comes from, seen from the tile that gets it.
AROUND = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0))


@dataclass(frozen=True)
class Form:
    """tile: side of a tile; kind: numpy type of the values; bands: arrays one after the other in data; absent:
    value of pixels of tiles without a row."""

    tile: int = TILE
    kind: str = "f8"
    bands: int = 1
    absent: float = math.nan

    def shape(self, tr: int, tc: int, height: int, width: int) -> tuple[int, int]:
        return min(self.tile, height - tr * self.tile), min(self.tile, width - tc * self.tile)

    def array(self, data: bytes, tr: int, tc: int, height: int, width: int) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(self.bands, *self.shape(tr, tc, height, width))


@dataclass(frozen=True)
class Chunks:
    """table: SCHEMA, one row a tile."""

    table: DataFrame
    form: Form


def _put(df: DataFrame, moved: bool) -> DataFrame:
    """df in the shared folder, bucketed by place. moved: tasks hold tiles of any bucket, so they are dealt first."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"gridloom_{uuid.uuid4().hex}", scratch_path(spark, "chunks")
    dealt = df.repartition(n, *PLACE) if moved else df
    dealt.write.bucketBy(n, *PLACE).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._gridloom_path = path
    return out


def drop(*chunks: Chunks) -> None:
    """Delete tile tables, once nothing that is still to run reads them."""
    from gridloom.session import discard

    for c in chunks:
        discard(c.table)


def places(scenes: DataFrame, tile: int) -> DataFrame:
    """Every tile of each scene, with the size of the scene."""
    rows = scenes.select("raster_id", "height", "width", F.explode(F.sequence(F.lit(0), F.expr(f"cast((height - 1) div {tile} as int)"))).alias("tr"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"cast((width - 1) div {tile} as int)"))).alias("tc"))


def from_pixels(pixels: DataFrame, scenes: DataFrame, value: str | tuple[str, ...] | None = None, tile: int = TILE) -> Chunks:
    """Tiles of pixels (raster_id, r, c): of a mask (value None) or of doubles (a column for each band), not-a-number
    where there is no pixel."""
    values = (value,) if isinstance(value, str) else value or ()
    kind, absent = ("u1", 0.0) if value is None else ("f8", math.nan)
    bands = max(1, len(values))
    at = ((F.col("r") % tile) * tile + F.col("c") % tile).cast("int")
    v = F.array(*(F.col(x).cast("double") for x in values)) if values else F.array(F.lit(1.0))
    rows = pixels.select("raster_id", F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"), F.struct(at.alias("at"), v.alias("v")).alias("p"))
    # sizes come by place, so that no raster is brought together
    tiles = rows.groupBy(*PLACE).agg(F.collect_list("p").alias("p")).join(places(scenes, tile), PLACE)
    form = Form(tile, kind, bands, absent)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, (tr, tc, h, w) = [], (batch.column(n).to_pylist() for n in ("tr", "tc", "height", "width"))
            for i in range(batch.num_rows):
                p = batch.column("p").slice(i, 1).flatten()
                place = p.field("at").to_numpy()
                a = np.full((bands, *form.shape(tr[i], tc[i], h[i], w[i])), absent, kind)
                a[:, place // tile, place % tile] = p.field("v").flatten().to_numpy().reshape(-1, bands).T
                data.append(a.tobytes())
            yield _batch([*(batch.column(n) for n in PLACE), batch.column("height"), batch.column("width")], data)

    return Chunks(_put(tiles.mapInArrow(pack, SCHEMA), False), form)


def _batch(columns: list, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], [*PLACE, "height", "width", "data"])


def to_pixels(chunks: Chunks, names: tuple[str, ...] = ("v",)) -> DataFrame:
    """Pixels with a value for each band; of a mask (names empty) the foreground. Not-a-number in the first band is no pixel."""
    form = chunks.form
    tile, kind = form.tile, form.kind
    number = "long" if kind.startswith("i") else "double"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raster, tr, tc, h, w, data in zip(*(batch.column(n).to_pylist() for n in (*PLACE, "height", "width", "data")), strict=True):
                a = form.array(data, tr, tc, h, w)
                keep = a[0] != 0 if not names or kind.startswith("i") else ~np.isnan(a[0])
                r, c = np.nonzero(keep)
                values = [pa.array(b[keep].astype("i8" if number == "long" else "f8")) for b in a[: len(names)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), raster)), pa.array((r + tr * tile).astype(np.int32)), pa.array((c + tc * tile).astype(np.int32)), *values], ["raster_id", "r", "c", *names])

    return chunks.table.mapInArrow(unpack, ", ".join(["raster_id long", "r int", "c int", *(f"{n} {number}" for n in names)]))


@dataclass
class Halo:
    """A tile and what lies around it, some pixels each way, one array for each band."""

    values: np.ndarray  # (bands, rows + 2 reach, columns + 2 reach)
    reach: int
    r0: int  # first row and column of the tile in its raster
    c0: int
    height: int
    width: int

    def inside(self) -> tuple[slice, slice]:
        """Rows and columns of the array that lie in the raster."""
        n, m = self.values.shape[1:]
        return slice(max(0, self.reach - self.r0), min(n, self.height - self.r0 + self.reach)), slice(max(0, self.reach - self.c0), min(m, self.width - self.c0 + self.reach))

    def bordered(self, mode: str, band: int = 0, **more) -> np.ndarray:
        """A band with what lies beyond the raster filled as numpy.pad does."""
        a, (rows, cols) = self.values[band], self.inside()
        pad = [(rows.start, a.shape[0] - rows.stop), (cols.start, a.shape[1] - cols.stop)]
        return np.pad(a[rows, cols], pad, mode=mode, **more)

    def core(self, a: np.ndarray) -> np.ndarray:
        k = self.reach
        return a[..., k : a.shape[-2] - k, k : a.shape[-1] - k] if k else a


def _strips(chunks: Chunks, reach: int) -> DataFrame:
    """Edge strips of every tile with the place of the tile that needs them."""
    form = chunks.form
    tile, kind = form.tile, form.kind

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raster, tr, tc, h, w, data in zip(*(batch.column(n).to_pylist() for n in (*PLACE, "height", "width", "data")), strict=True):
                a = form.array(data, tr, tc, h, w)
                for dr, dc in AROUND:
                    to_r, to_c = tr - dr, tc - dc
                    if 0 <= to_r * tile < h and 0 <= to_c * tile < w:
                        rows = slice(None) if not dr else slice(-reach, None) if dr < 0 else slice(0, reach)
                        cols = slice(None) if not dc else slice(-reach, None) if dc < 0 else slice(0, reach)
                        part = a[:, rows, cols]
                        # of a mask, empty strips say nothing
                        if kind != "u1" or part.any():
                            out.append((raster, to_r, to_c, h, w, dr, dc, part.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), *[pa.int32()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*PLACE, "height", "width", "dr", "dc", "strip"])

    sent = chunks.table.mapInArrow(cut, "raster_id long, tr int, tc int, height int, width int, dr int, dc int, strip binary")
    return sent.groupBy(*PLACE).agg(F.first("height").alias("height2"), F.first("width").alias("width2"), F.collect_list(F.struct("dr", "dc", "strip")).alias("strips"))


def stencil(chunks: Chunks, reach: int, kernel: Callable, kind: str | None = None, bands: int = 1, more: DataFrame | None = None, many: bool = False) -> Chunks:
    """kernel(tile with its halo) for every tile; its result has the tile's size, and as many bands as said.

    more: a table by place whose other columns the kernel gets by name; many: the kernel gets a list of tiles."""
    form = chunks.form
    if not 0 < reach <= form.tile:
        raise ValueError(f"a halo of {reach} pixels needs tiles of as many at least, not {form.tile}")
    kind = kind or form.kind
    names = [c for c in more.columns if c not in PLACE] if more is not None else []
    own = chunks.table.join(_strips(chunks, reach), PLACE, "full_outer")
    own = own.select(*PLACE, F.coalesce("height", "height2").alias("height"), F.coalesce("width", "width2").alias("width"), "data", "strips")
    if more is not None:
        own = own.join(more, PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, tiles = [], []
            extra = {n: batch.column(n).to_pylist() for n in names}
            fields = (batch.column(n).to_pylist() for n in (*PLACE, "height", "width", "data", "strips"))
            for i, (_, tr, tc, h, w, core, strips) in enumerate(zip(*fields, strict=True)):
                n, m = form.shape(tr, tc, h, w)
                a = np.full((form.bands, n + 2 * reach, m + 2 * reach), form.absent, form.kind)
                if core is not None:
                    a[:, reach : reach + n, reach : reach + m] = form.array(core, tr, tc, h, w)
                for s in strips or ():
                    rows, cols = _span(s["dr"], n, reach, h - (tr + 1) * form.tile), _span(s["dc"], m, reach, w - (tc + 1) * form.tile)
                    a[:, rows, cols] = np.frombuffer(s["strip"], form.kind).reshape(form.bands, rows.stop - rows.start, cols.stop - cols.start)
                halo = Halo(a, reach, tr * form.tile, tc * form.tile, h, w)
                if many:
                    tiles.append(halo)
                else:
                    data.append(np.ascontiguousarray(kernel(halo, **{k: v[i] for k, v in extra.items()}), kind).tobytes())
            if many:
                data = [np.ascontiguousarray(y, kind).tobytes() for y in kernel(tiles)]
            yield _batch([batch.column(c) for c in (*PLACE, "height", "width")], data)

    return Chunks(_put(own.mapInArrow(run, SCHEMA), False), Form(form.tile, kind, bands, 0.0 if kind == "u1" else math.nan))


def _span(d: int, n: int, reach: int, left: int) -> slice:
    """Where a strip from one side lies in a padded array; left: pixels of the raster beyond the tile."""
    return slice(0, reach) if d < 0 else slice(reach, reach + n) if d == 0 else slice(reach + n, reach + n + min(reach, left))


# --- masks


def _run(a: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """How many of the places i - before .. i + after along an axis hold a pixel; beyond the array is none."""
    total = np.cumsum(np.pad(a.astype(np.int32), [(before + 1, after) if k == axis else (0, 0) for k in range(2)]), axis=axis)
    n = a.shape[axis]
    take = [slice(None)] * 2
    high, low = take.copy(), take.copy()
    high[axis], low[axis] = slice(before + after + 1, before + after + 1 + n), slice(0, n)
    return total[tuple(high)] - total[tuple(low)]


def _grown(a: np.ndarray, before: int, after: int) -> np.ndarray:
    return _run(_run(a, after, before, 0) > 0, after, before, 1) > 0


def _shrunk(a: np.ndarray, radius: int) -> np.ndarray:
    return ~_grown(~a, radius, radius)


def _within(h: Halo, a: np.ndarray, beyond: bool) -> np.ndarray:
    """The array with a value beyond the raster."""
    out = np.full(a.shape, beyond)
    out[h.inside()] = a[h.inside()]
    return out


def morphology(mask: Chunks, steps: list[tuple[str, int]]) -> Chunks:
    """Dilations and erosions by squares, in order, as one kernel: ("dilate" or "erode", radius). The border does not erode."""

    def kernel(h: Halo) -> np.ndarray:
        a = h.values[0].astype(bool)
        for step, radius in steps:
            a = _grown(_within(h, a, False), radius, radius) if step == "dilate" else _shrunk(_within(h, a, True), radius)
        return h.core(_within(h, a, False))

    return stencil(mask, max(1, sum(r for _, r in steps)), kernel)


def dilate(mask: Chunks, radius: int = 1) -> Chunks:
    return morphology(mask, [("dilate", radius)])


def erode(mask: Chunks, radius: int = 1) -> Chunks:
    return morphology(mask, [("erode", radius)])


def close_open(mask: Chunks, close_radius: int = 2, open_radius: int = 1) -> Chunks:
    """Closing, then opening unless its radius is 0: one exchange of strips."""
    steps = [("dilate", close_radius), ("erode", close_radius)]
    return morphology(mask, steps + ([("erode", open_radius), ("dilate", open_radius)] if open_radius > 0 else []))


def dilate_line(mask: Chunks, width: int) -> Chunks:
    """Dilation by a square of any side; an even one reaches one pixel further up and to the left."""
    before = width // 2
    return stencil(mask, max(1, before), lambda h: h.core(_within(h, _grown(_within(h, h.values[0].astype(bool), False), before, width - 1 - before), False)))


def plus(mask: Chunks, grow: bool) -> Chunks:
    """Dilation or erosion by the pixel and the four next to it; the border does not erode."""

    def kernel(h: Halo) -> np.ndarray:
        a = _within(h, h.values[0].astype(bool), not grow)
        near = [a, *(np.roll(a, d, axis) for d in (-1, 1) for axis in (0, 1))]
        return h.core(_within(h, np.logical_or.reduce(near) if grow else np.logical_and.reduce(near), False))

    return stencil(mask, 1, kernel)


def neighbour_count(mask: Chunks) -> Chunks:
    """For each pixel how many of its eight neighbours are foreground, not-a-number where it is none itself."""

    def kernel(h: Halo) -> np.ndarray:
        a = h.values[0].astype(bool)
        n = _run(_run(a, 1, 1, 0), 1, 1, 1) - a
        return h.core(np.where(a, n.astype(float), np.nan))

    return stencil(mask, 1, kernel, "f8")


# --- values


def _filtered(a: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Weighted sums along an axis; the array loses len(weights) // 2 at both ends."""
    n = a.shape[axis] - len(weights) + 1
    out = None
    for k, w in enumerate(weights):
        part = w * (a[k : k + n] if axis == 0 else a[:, k : k + n])
        out = part if out is None else out + part
    return out


def _smooth(a: np.ndarray, weights: list[float]) -> np.ndarray:
    return _filtered(_filtered(a, weights, 0), weights, 1)


def gaussian(raster: Chunks, sigma: float, radius: int | None = None, mirror_edge: bool = False) -> Chunks:
    """Gaussian smoothing; borders are mirrored, with the border pixel repeated (mirror_edge) or not."""
    from gridloom.operators.stencil import gaussian_kernel

    w = gaussian_kernel(sigma, radius)
    mode = "symmetric" if mirror_edge else "reflect"
    return stencil(raster, len(w) // 2, lambda h: _smooth(h.bordered(mode), w))


def _sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients gx and gy of all but the outermost pixels."""
    across, down = a[:, 2:] - a[:, :-2], a[2:] - a[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def gradient(raster: Chunks) -> Chunks:
    """Bands gx, gy, magnitude and direction (0..180 degrees), not-a-number on the border of the raster."""

    def kernel(h: Halo) -> np.ndarray:
        gx, gy = _sobel(h.bordered("constant", constant_values=np.nan))
        angle = np.degrees(np.arctan2(gy, gx))
        return np.stack([gx, gy, np.sqrt(gx * gx + gy * gy), np.where(angle < 0, angle + 180, angle)])

    return stencil(raster, 1, kernel, bands=4)


def median(raster: Chunks, radius: int = 3) -> Chunks:
    """Median over a square, the border repeated; places without a pixel are left out."""

    def kernel(h: Halo) -> np.ndarray:
        side = 2 * radius + 1
        views = np.lib.stride_tricks.sliding_window_view(h.bordered("edge"), (side, side))
        full = not np.isnan(h.values[0][h.inside()]).any()
        return np.stack([(np.median if full else np.nanmedian)(v.reshape(v.shape[0], -1), axis=1) for v in views])

    return stencil(raster, radius, kernel)


def _ridge_parts(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the scaled Hessian, the smaller one in magnitude first, and their norm; the array loses one pixel around."""
    s2 = sigma * sigma
    hrr, hcc = s2 * (a[2:, 1:-1] - 2 * a[1:-1, 1:-1] + a[:-2, 1:-1]), s2 * (a[1:-1, 2:] - 2 * a[1:-1, 1:-1] + a[1:-1, :-2])
    hrc = s2 * (a[2:, 2:] - a[2:, :-2] - a[:-2, 2:] + a[:-2, :-2]) / 4
    half, root = (hrr + hcc) / 2, np.sqrt(((hrr - hcc) / 2) ** 2 + hrc**2)
    p, m = half + root, half - root
    less = np.abs(p) < np.abs(m)
    l1, l2 = np.where(less, p, m), np.where(less, m, p)
    return l1, l2, np.sqrt(l1**2 + l2**2)


def frangi(raster: Chunks, sigmas=(1.2, 2.0, 3.2, 4.8), bright: bool = True, dark: bool = False, beta: float = 0.5) -> Chunks:
    """Ridge strength from the eigenvalues of the Hessian, the highest over the scales and the kinds asked for.

    A first pass finds the largest Hessian norm of each raster and scale, half of which is the structure constant; the
    smoothings of a scale serve bright and dark ridges alike. The outermost pixels have none."""
    from gridloom.operators.stencil import gaussian_kernel

    kernels = [gaussian_kernel(s) for s in sigmas]
    reach = max(len(w) // 2 for w in kernels) + 1

    def parts(h: Halo) -> Iterator[tuple]:
        a = h.bordered("symmetric")
        rows, cols = np.indices((a.shape[0] - 2 * reach, a.shape[1] - 2 * reach))
        edge = (rows + h.r0 == 0) | (rows + h.r0 == h.height - 1) | (cols + h.c0 == 0) | (cols + h.c0 == h.width - 1)
        for sigma, w in zip(sigmas, kernels, strict=True):
            cut = reach - 1 - len(w) // 2
            yield edge, *_ridge_parts(_smooth(a[cut : a.shape[0] - cut, cut : a.shape[1] - cut], w), sigma)

    def norms(h: Halo) -> np.ndarray:
        return np.array([np.where(edge, 0, s).max() for edge, _, _, s in parts(h)])

    found = stencil(raster, reach, norms)
    names = [f"g{k}" for k in range(len(sigmas))]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = np.array([np.frombuffer(x, "f8") for x in batch.column("data").to_pylist()]).reshape(-1, len(sigmas))
            yield pa.RecordBatch.from_arrays([batch.column("raster_id"), *(pa.array(np.ascontiguousarray(c)) for c in top.T)], ["raster_id", *names])

    top = found.table.mapInArrow(listed, "raster_id long, " + ", ".join(f"{n} double" for n in names)).groupBy("raster_id").agg(*(F.max(n).alias(n) for n in names))

    def strength(h: Halo, **most: float) -> np.ndarray:
        best = None
        for name, (edge, l1, l2, s) in zip(names, parts(h), strict=True):
            g = most[name] / 2
            if g > 0:
                with np.errstate(divide="ignore", invalid="ignore"):
                    v = np.exp(-((l1 / l2) ** 2) / (2 * beta * beta)) * (1 - np.exp(-(s**2) / (2 * g * g)))
                v = np.where((l2 < 0) & bright | (l2 > 0) & dark, v, 0.0)
            else:
                v = np.zeros(l1.shape)
            best = v if best is None else np.maximum(best, v)
        return np.where(edge, np.nan, best)

    return stencil(raster, reach, strength, more=found.table.select(*PLACE).join(top, "raster_id"))


def clahe(raster: Chunks, clip_limit: float = 2.0, grid: int = 8) -> Chunks:
    """Contrast-limited equalisation of whole numbers 0..255 on a grid of cells over each raster.

    A cell's histogram has 256 bins; counts above the limit are spread over all bins, and a pixel's value is
    interpolated between the mappings of the four cells around it. Tiles send counts, 256 numbers a cell at
    most, and get the mappings of the cells that they touch."""
    form, last = raster.form, grid - 1

    def cells(r0: int, n: int, size: int) -> np.ndarray:
        return np.minimum((np.arange(r0, r0 + n) / (size / grid)).astype(int), last)

    def levels(a: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(a), 0, 255).astype(int)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raster_id, tr, tc, h, w, data in zip(*(batch.column(n).to_pylist() for n in (*PLACE, "height", "width", "data")), strict=True):
                a = form.array(data, tr, tc, h, w)[0]
                gy, gx = cells(tr * form.tile, a.shape[0], h), cells(tc * form.tile, a.shape[1], w)
                known = ~np.isnan(a)
                key, n = np.unique(((gy[:, None] * grid + gx) * 256 + levels(np.where(known, a, 0)))[known], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), raster_id)), pa.array((key // 256 // grid).astype(np.int32)), pa.array((key // 256 % grid).astype(np.int32)), pa.array((key % 256).astype(np.int32)), pa.array(n)], ["raster_id", "gy", "gx", "bin", "n"])

    def mapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            luts = []
            for bins in batch.column("bins").to_pylist():
                n = np.zeros(256)
                n[[b["bin"] for b in bins]] = [b["n"] for b in bins]
                area = n.sum()
                limit = max(math.floor(clip_limit * area / 256), 1)
                n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256
                luts.append((np.cumsum(n) * 255 / area).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("raster_id", "gy", "gx")), pa.array(luts, pa.binary())], ["raster_id", "gy", "gx", "lut"])

    counts = raster.table.mapInArrow(counted, "raster_id long, gy int, gx int, bin int, n long").groupBy("raster_id", "gy", "gx", "bin").agg(F.sum("n").alias("n"))
    luts = counts.groupBy("raster_id", "gy", "gx").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).mapInArrow(mapping, "raster_id long, gy int, gx int, lut binary")

    def touched(at: str, size: str):
        """Cells whose middles are next to the first and the last pixel of the tile, and those between."""
        first, end = F.col(at) * form.tile, F.least((F.col(at) + 1) * form.tile, F.col(size)) - 1
        low, high = (F.floor((x + 0.5) * grid / F.col(size) - 0.5) for x in (first, end))
        return F.explode(F.sequence(F.least(F.greatest(low, F.lit(0)), F.lit(last)).cast("int"), F.least(F.greatest(high + 1, F.lit(0)), F.lit(last)).cast("int")))

    wanted = raster.table.select(*PLACE, "height", "width").withColumn("gy", touched("tr", "height")).withColumn("gx", touched("tc", "width"))
    maps = wanted.join(luts, ["raster_id", "gy", "gx"]).groupBy(*PLACE).agg(F.collect_list(F.struct("gy", "gx", "lut")).alias("maps"))
    own = raster.table.join(maps, PLACE)

    def near(r0: int, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = (np.arange(r0, r0 + n) + 0.5) / (size / grid) - 0.5
        low = np.floor(f)
        return np.clip(low, 0, last).astype(int), np.clip(low + 1, 0, last).astype(int), f - low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for tr, tc, h, w, raw, maps_ in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "height", "width", "data", "maps")), strict=True):
                a = form.array(raw, tr, tc, h, w)[0]
                table = np.zeros((grid, grid, 256))
                for m in maps_:
                    table[m["gy"], m["gx"]] = np.frombuffer(m["lut"], "f8")
                (y0, y1, fy), (x0, x1, fx) = near(tr * form.tile, a.shape[0], h), near(tc * form.tile, a.shape[1], w)
                fy, level = fy[:, None], levels(np.nan_to_num(a))
                value = sum(table[y[:, None], x, level] * wy * wx for y, wy in ((y0, 1 - fy), (y1, fy)) for x, wx in ((x0, 1 - fx), (x1, fx)))
                data.append(np.where(np.isnan(a), np.nan, np.floor(value + 0.5)).tobytes())
            yield _batch([batch.column(n) for n in (*PLACE, "height", "width")], data)

    return Chunks(_put(own.mapInArrow(run, SCHEMA), False), Form(form.tile))


# --- what needs the whole raster


def _labelled(mask: Chunks, eight: bool) -> Chunks:
    """Labels of the components inside each tile, 1 + the smallest linear index of a component; 0 is background."""
    form = mask.form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for tr, tc, h, w, raw in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "height", "width", "data")), strict=True):
                a = form.array(raw, tr, tc, h, w)[0]
                r, c = np.nonzero(a)
                out = np.zeros(a.shape, np.int64)
                out[r, c] = _label_block(r + tr * form.tile, c + tc * form.tile, eight) + 1
                data.append(out.tobytes())
            yield _batch([batch.column(n) for n in (*PLACE, "height", "width")], data)

    return Chunks(_put(mask.table.mapInArrow(run, SCHEMA), False), Form(form.tile, "i8", 1, 0))


def _relabelled(labels: Chunks, names: DataFrame) -> Chunks:
    """Labels replaced by those of names (raster_id, tr, tc, label, lowest), where they are listed."""
    listed = names.groupBy(*PLACE).agg(F.collect_list(F.struct("label", "lowest")).alias("names"))
    own = labels.table.join(listed, PLACE, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for raw, pairs in zip(batch.column("data").to_pylist(), batch.column("names").to_pylist(), strict=True):
                if pairs:
                    a, old = np.frombuffer(raw, "i8"), np.array(sorted((p["label"], p["lowest"]) for p in pairs))
                    at = np.minimum(np.searchsorted(old[:, 0], a), len(old) - 1)
                    raw = np.where(old[at, 0] == a, old[at, 1], a).tobytes()
                data.append(raw)
            yield _batch([batch.column(n) for n in (*PLACE, "height", "width")], data)

    return Chunks(_put(own.mapInArrow(run, SCHEMA), False), labels.form)


def components(mask: Chunks, eight: bool = True) -> Chunks:
    """Labels of connected pixels, 1 + r * STRIDE + c of the first one; 0 is background.

    Tiles are labelled where they are; edge strips one pixel wide tell which labels touch across seams,
    and the components of that graph come back to the tiles as short lists."""
    local = _labelled(mask, eight)
    form = local.form
    tile = form.tile

    def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            fields = (batch.column(n).to_pylist() for n in (*PLACE, "height", "width", "data", "strips"))
            for raster, tr, tc, h, w, core, strips in zip(*fields, strict=True):
                n, m = form.shape(tr, tc, h, w)
                a = np.zeros((n + 2, m + 2), np.int64)
                a[1:-1, 1:-1] = form.array(core, tr, tc, h, w)[0]
                for s in strips or ():
                    # seams are looked at from below, and to both sides
                    if s["dr"] <= 0:
                        rows, cols = _span(s["dr"], n, 1, h - (tr + 1) * tile), _span(s["dc"], m, 1, w - (tc + 1) * tile)
                        a[rows, cols] = np.frombuffer(s["strip"], "i8").reshape(rows.stop - rows.start, cols.stop - cols.start)
                for dr, dc in ((-1, 0), (0, -1), *(((-1, -1), (-1, 1)) if eight else ())):
                    x, y = a[1 : n + 1, 1 : m + 1], a[1 + dr : n + 1 + dr, 1 + dc : m + 1 + dc]
                    seam = np.zeros((n, m), bool)
                    if dr:
                        seam[0] = True
                    if dc < 0:
                        seam[:, 0] = True
                    if dc > 0:
                        seam[:, -1] = True
                    hit = seam & (x > 0) & (y > 0) & (x != y)
                    if hit.any():
                        pairs = np.unique(np.stack([x[hit], y[hit]], 1), axis=0)
                        out.append(np.column_stack([np.full(len(pairs), raster), pairs]))
            got = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, k]) for k in range(3)], ["raster_id", "label", "other"])

    near = local.table.join(_strips(local, 1), PLACE, "left").select(*PLACE, "height", "width", "data", "strips")
    pairs = near.mapInArrow(touching, "raster_id long, label long, other long").distinct()
    edges = pairs.select(F.struct("raster_id", "label").alias("a"), F.struct("raster_id", F.col("other").alias("label")).alias("b"))
    found = graph_components(edges)
    place = F.col("node.label") - 1
    names = found.filter("node <> component").select(
        F.col("node.raster_id").alias("raster_id"), F.col("node.label").alias("label"), F.col("component.label").alias("lowest"), place.alias("first")
    )
    # a label names the first pixel of its part, so it says in which tile that is
    at_r, at_c = F.floor(F.col("first") / STRIDE), F.col("first") % STRIDE
    return _relabelled(local, names.select("raster_id", F.floor(at_r / tile).cast("int").alias("tr"), F.floor(at_c / tile).cast("int").alias("tc"), "label", "lowest"))


def _columns(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column how many pixels from the top, and from the bottom, are foreground before the first that is not."""
    n = len(a)
    full = a.all(axis=0)
    return np.where(full, n, a.argmin(axis=0)), np.where(full, n, a[::-1].argmin(axis=0))


def distance(mask: Chunks) -> Chunks:
    """Distance of each foreground pixel to the nearest background pixel; 0 is background, infinite where there is none.

    Of each tile the ends of its columns (two whole numbers a column) meet those of the tiles above and
    below; then squared heights meet along a row of tiles, for the lower envelope of each pixel row."""
    form = mask.form
    tile = form.tile

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, bottom = [], []
            for tr, tc, h, w, raw in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "height", "width", "data")), strict=True):
                t, b = _columns(form.array(raw, tr, tc, h, w)[0].astype(bool))
                top.append(t.astype("i4").tobytes())
                bottom.append(b.astype("i4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*PLACE, "height")), pa.array(top, pa.binary()), pa.array(bottom, pa.binary())], [*PLACE, "height", "top", "bottom"])

    def carried(key, part):
        """For the tiles of one column of tiles: foreground above and below each; a tile without a row is background."""
        part = part.sort_by("tr")
        tr, h = part.column("tr").to_pylist(), part.column("height")[0].as_py()
        top, bottom = ([np.frombuffer(x, "i4").astype(float) for x in part.column(n).to_pylist()] for n in ("top", "bottom"))
        rows = [min(tile, h - t * tile) for t in tr]
        above, below = [None] * len(tr), [None] * len(tr)
        for i in range(len(tr)):
            # beyond the raster there is no background; beyond a tile that is not there, it is next
            start = np.full(len(top[i]), np.inf if tr[i] == 0 else 0.0)
            above[i] = start if i == 0 or tr[i - 1] != tr[i] - 1 else np.where(bottom[i - 1] == rows[i - 1], bottom[i - 1] + above[i - 1], bottom[i - 1])
        for i in range(len(tr) - 1, -1, -1):
            last = (tr[i] + 1) * tile >= h
            start = np.full(len(top[i]), np.inf if last else 0.0)
            below[i] = start if i == len(tr) - 1 or tr[i + 1] != tr[i] + 1 else np.where(top[i + 1] == rows[i + 1], top[i + 1] + below[i + 1], top[i + 1])
        out = [part.column(n) for n in PLACE]
        return pa.Table.from_arrays([*out, *(pa.array([x.tobytes() for x in side], pa.binary()) for side in (above, below))], [*PLACE, "above", "below"])

    column = mask.table.mapInArrow(ends, "raster_id long, tr int, tc int, height int, top binary, bottom binary").groupBy("raster_id", "tc")
    around = column.applyInArrow(carried, "raster_id long, tr int, tc int, above binary, below binary")
    own = mask.table.join(around, PLACE)

    def heights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            fields = (batch.column(n).to_pylist() for n in ("tr", "tc", "height", "width", "data", "above", "below"))
            for tr, tc, h, w, raw, above, below in zip(*fields, strict=True):
                a = form.array(raw, tr, tc, h, w)[0].astype(bool)
                g, up, down = np.zeros(a.shape), np.frombuffer(above, "f8"), np.frombuffer(below, "f8")
                run = up
                for i in range(len(a)):
                    run = np.where(a[i], run + 1, 0)
                    g[i] = run
                run = down
                for i in range(len(a) - 1, -1, -1):
                    run = np.where(a[i], run + 1, 0)
                    g[i] = np.minimum(g[i], run)
                data.append(g.tobytes())
            yield _batch([batch.column(n) for n in (*PLACE, "height", "width")], data)

    def along(key, part):
        part = part.sort_by("tc")
        tr, w = part.column("tr")[0].as_py(), part.column("width")[0].as_py()
        h = part.column("height")[0].as_py()
        columns = part.column("tc").to_pylist()
        band = np.zeros((form.shape(tr, 0, h, w)[0], w))
        for tc, raw in zip(columns, part.column("data").to_pylist(), strict=True):
            n, m = form.shape(tr, tc, h, w)
            band[:, tc * tile : tc * tile + m] = np.frombuffer(raw, "f8").reshape(n, m)
        for i, row in enumerate(band):
            if row.any():
                band[i] = np.sqrt(_envelope(row**2))
        data = [np.ascontiguousarray(band[:, tc * tile : (tc + 1) * tile]).tobytes() for tc in columns]
        out = [part.column(n) for n in (*PLACE, "height", "width")]
        return pa.Table.from_arrays([*out, pa.array(data, pa.binary())], [*PLACE, "height", "width", "data"])

    rows = own.mapInArrow(heights, SCHEMA).groupBy("raster_id", "tr").applyInArrow(along, SCHEMA)
    return Chunks(_put(rows, True), Form(tile, "f8", 1, 0.0))
