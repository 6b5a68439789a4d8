"""Convolutional networks over tables of tiles, with weights from a table.

A network is a function of (images, channels, rows, columns) and its weights; layers work in numpy on
several tiles at once. A tile is computed with a halo as deep as the network's field of view and cut at
the border of its raster, where layers pad with zeros as they do for a whole image; pooling starts at
multiples of the network's stride in every tile. So the result is that of the whole image, whatever the
tiles, and needs no blending. Rasters whose sides are no multiple of the stride are mirrored up to one.

Weights are rows (key, shape, w), as a checkpoint has them: ``enc1.0.weight`` of a convolution, and
``.weight .bias .running_mean .running_var`` of a normalisation. A network's weights are sent to every
task; ``MOST_WEIGHTS`` bounds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import chunks
from gridloom.operators.chunks import Chunks, Form, Halo

Weights = dict[str, np.ndarray]
MOST_WEIGHTS = 64_000_000
EPS = 1e-5
#: Tiles of one size that go through a network together.
TOGETHER = 4


def convolved(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """A convolution (out, in, k, k) of odd side with zeros around, one matrix product for each place of the kernel."""
    k = w.shape[-1] // 2
    p = np.pad(x, ((0, 0), (0, 0), (k, k), (k, k)))
    n, m = x.shape[2:]
    out = np.zeros((len(x), len(w), n, m), np.result_type(x, w))
    for i in range(w.shape[2]):
        for j in range(w.shape[3]):
            out += np.einsum("oc,bcrs->bors", w[:, :, i, j], p[:, :, i : i + n, j : j + m], optimize=True)
    return out if b is None else out + b[:, None, None]


def transposed(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A transposed convolution (in, out, 2, 2) of stride 2: every pixel becomes a square."""
    n, m = x.shape[2:]
    out = np.einsum("bcrs,coij->borisj", x, w, optimize=True)
    return out.reshape(len(x), w.shape[1], 2 * n, 2 * m) + b[:, None, None]


def normalised(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    scale = weights[f"{name}.weight"] / np.sqrt(weights[f"{name}.running_var"] + EPS)
    return x * scale[:, None, None] + (weights[f"{name}.bias"] - weights[f"{name}.running_mean"] * scale)[:, None, None]


def pooled(x: np.ndarray) -> np.ndarray:
    b, c, n, m = x.shape
    return x[:, :, : n // 2 * 2, : m // 2 * 2].reshape(b, c, n // 2, 2, m // 2, 2).max(axis=(3, 5))


def shuffled(x: np.ndarray, factor: int) -> np.ndarray:
    """Groups of factor * factor channels become pixels."""
    b, c, n, m = x.shape
    return x.reshape(b, c // factor**2, factor, factor, n, m).transpose(0, 1, 4, 2, 5, 3).reshape(b, c // factor**2, n * factor, m * factor)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


@dataclass(frozen=True)
class Network:
    """forward: of images and weights; shapes: those of its weights; reach: how far a result looks; stride: of its pooling;
    scale: result pixels for one of the image, each way."""

    forward: Callable[[np.ndarray, Weights], np.ndarray]
    shapes: dict[str, tuple[int, ...]]
    reach: int
    stride: int = 1
    scale: int = 1
    bands: int = 1


def _conv(shapes: dict, name: str, inside: int, out: int, k: int = 3) -> None:
    shapes |= {f"{name}.weight": (out, inside, k, k), f"{name}.bias": (out,)}


def _norm(shapes: dict, name: str, n: int) -> None:
    shapes |= {f"{name}.{x}": (n,) for x in ("weight", "bias", "running_mean", "running_var")}


def _pair(x: np.ndarray, w: Weights, name: str, at: tuple[int, int, int, int] = (0, 1, 3, 4)) -> np.ndarray:
    """Two convolutions, each normalised and cut at zero; at: their places and those of the normalisations in the block."""
    for conv, norm in (at[:2], at[2:]):
        x = relu(normalised(convolved(x, w[f"{name}.{conv}.weight"], w[f"{name}.{conv}.bias"]), w, f"{name}.{norm}"))
    return x


def u_net(widths: tuple[int, ...] = (64, 128, 256, 512, 1024), bands: int = 3) -> Network:
    """A U-Net: pairs of convolutions on every level, halved by pooling, doubled by transposed convolutions, with the
    encoder's features beside the decoder's."""
    depth, shapes = len(widths) - 1, {}

    def pair(name: str, inside: int, out: int) -> None:
        for k, n in ((0, inside), (3, out)):
            _conv(shapes, f"{name}.conv.{k}", n, out)
            _norm(shapes, f"{name}.conv.{k + 1}", out)

    for i, n in enumerate(widths):
        pair(f"enc{i + 1}" if i < depth else "bottleneck", bands if i == 0 else widths[i - 1], n)
    for i in range(depth, 0, -1):
        shapes |= {f"upconv{i}.weight": (widths[i], widths[i - 1], 2, 2), f"upconv{i}.bias": (widths[i - 1],)}
        pair(f"dec{i}", 2 * widths[i - 1], widths[i - 1])
    _conv(shapes, "conv_final", widths[0], 1, 1)

    def forward(x: np.ndarray, w: Weights) -> np.ndarray:
        kept = []
        for i in range(depth):
            kept.append(_pair(x, w, f"enc{i + 1}.conv"))
            x = pooled(kept[-1])
        x = _pair(x, w, "bottleneck.conv")
        for i in range(depth, 0, -1):
            x = _pair(np.concatenate([transposed(x, w[f"upconv{i}.weight"], w[f"upconv{i}.bias"]), kept[i - 1]], 1), w, f"dec{i}.conv")
        return logistic(convolved(x, w["conv_final.weight"], w["conv_final.bias"]))

    # two pixels a pair, on the way down and up, and a pooling's width of doubt about where it looks
    reach = sum(4 << i for i in range(depth)) + (2 << depth) + (1 << depth)
    return Network(forward, shapes, -(-reach >> depth) << depth if depth else reach, 1 << depth)


def fast_road_net(widths: tuple[int, int] = (32, 64), bands: int = 3) -> Network:
    """A light network: two pairs of convolutions with one pooling between them, one doubling, one more convolution."""
    a, b = widths
    shapes: dict = {}
    for k, inside, out in ((0, bands, a), (3, a, a), (7, a, b), (10, b, b)):
        _conv(shapes, f"encoder.{k}", inside, out)
        _norm(shapes, f"encoder.{k + 1}", out)
    shapes |= {"decoder.0.weight": (b, a, 2, 2), "decoder.0.bias": (a,)}
    _norm(shapes, "decoder.1", a)
    _conv(shapes, "decoder.3", a, a)
    _norm(shapes, "decoder.4", a)
    _conv(shapes, "decoder.6", a, 1, 1)

    def forward(x: np.ndarray, w: Weights) -> np.ndarray:
        x = _pair(pooled(_pair(x, w, "encoder")), w, "encoder", (7, 8, 10, 11))
        x = relu(normalised(transposed(x, w["decoder.0.weight"], w["decoder.0.bias"]), w, "decoder.1"))
        x = relu(normalised(convolved(x, w["decoder.3.weight"], w["decoder.3.bias"]), w, "decoder.4"))
        return logistic(convolved(x, w["decoder.6.weight"], w["decoder.6.bias"]))

    return Network(forward, shapes, 10, 2)


def compact(bands: int = 3, features: int = 64, layers: int = 16, scale: int = 4, activation: str = "prelu") -> Network:
    """Enlargement: convolutions at the image's own size, pixel shuffle, plus the nearest enlargement."""
    shapes: dict = {}
    _conv(shapes, "body.0", bands, features)
    for k in range(layers):
        _conv(shapes, f"body.{2 * k + 2}", features, features)
    _conv(shapes, f"body.{2 * layers + 2}", features, bands * scale * scale)
    if activation == "prelu":
        shapes |= {f"body.{2 * k + 1}.weight": (features,) for k in range(layers + 1)}

    def active(x: np.ndarray, w: Weights, k: int) -> np.ndarray:
        if activation == "relu":
            return relu(x)
        slope = w[f"body.{k}.weight"][:, None, None] if activation == "prelu" else 0.1
        return np.where(x > 0, x, slope * x)

    def forward(x: np.ndarray, w: Weights) -> np.ndarray:
        y = x
        for k in range(layers + 1):
            y = active(convolved(y, w[f"body.{2 * k}.weight"], w[f"body.{2 * k}.bias"]), w, 2 * k + 1)
        y = convolved(y, w[f"body.{2 * layers + 2}.weight"], w[f"body.{2 * layers + 2}.bias"])
        return shuffled(y, scale) + x.repeat(scale, axis=2).repeat(scale, axis=3)

    return Network(forward, shapes, layers + 2, 1, scale, bands)


#: Networks by name; names that are not known get the first.
NETWORKS: dict[str, Callable[..., Network]] = {"unet": u_net, "u-net": u_net, "fast": fast_road_net, "compact": compact}


def network(name: str, **settings) -> Network:
    return NETWORKS.get(name.lower(), u_net)(**settings)


def weights_of(table: DataFrame, net: Network, kind: str = "f4") -> Weights:
    """The weights of a network from rows (key, shape, w), in single precision unless told otherwise; an error names what is missing or of another shape."""
    wanted = table.filter(F.col("key").isin(sorted(net.shapes))) if len(net.shapes) < 1000 else table
    size = wanted.agg(F.sum(F.size("w"))).first()[0] or 0
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights are more than the {MOST_WEIGHTS} that are sent to tasks")
    found = {r["key"]: np.array(r["w"], kind).reshape(r["shape"]) for r in wanted.collect()}
    wrong = sorted(k for k, s in net.shapes.items() if k not in found or found[k].shape != s)
    if wrong:
        raise ValueError(f"no weights of the right shape for {', '.join(wrong[:5])}")
    return found


def applied(images: Chunks, net: Network, weights: Weights, together: int = TOGETHER, kind: str = "f4") -> Chunks:
    """The network's result over every raster: tiles of the image's bands, the result's size being ``scale`` times theirs;
    kind: the precision of images and result."""
    shared = images.table.sparkSession.sparkContext.broadcast(weights)
    stride, reach = net.stride, net.reach
    if images.form.tile % stride:
        raise ValueError(f"tiles of {images.form.tile} pixels are no multiple of {stride}")

    def many(tiles: list[Halo]) -> Iterator[np.ndarray]:
        cut = [[h.values[(slice(None), *h.inside())] for h in tiles[i : i + together]] for i in range(0, len(tiles), together)]
        for i, part in enumerate(cut):
            out: list = [None] * len(part)
            padded = [np.pad(a, ((0, 0), *((0, -n % stride) for n in a.shape[1:])), mode="reflect").astype(kind) for a in part]
            for shape in {a.shape for a in padded}:
                at = [k for k, a in enumerate(padded) if a.shape == shape]
                for k, y in zip(at, net.forward(np.stack([padded[k] for k in at]), shared.value), strict=True):
                    out[k] = y
            for h, y in zip(tiles[i * together :], out, strict=False):
                rows, cols = h.inside()
                n, m = h.values.shape[1] - 2 * reach, h.values.shape[2] - 2 * reach
                top, left = (reach - rows.start) * net.scale, (reach - cols.start) * net.scale
                yield y[:, top : top + n * net.scale, left : left + m * net.scale]

    out = chunks.stencil(images, reach, many, kind, net.bands, many=True)
    if net.scale == 1:
        return out
    form = Form(out.form.tile * net.scale, kind, net.bands)
    sized = out.table.select("raster_id", "tr", "tc", (F.col("height") * net.scale).alias("height"), (F.col("width") * net.scale).alias("width"), "data")
    return Chunks(sized, form)


def saved(table: DataFrame, path: str) -> None:
    """Weights (key, shape, w) as a table, sorted by key: what :func:`weights_of` reads again."""
    table.select("key", "shape", F.col("w").cast("array<float>").alias("w")).sort("key").write.mode("overwrite").parquet(path)
