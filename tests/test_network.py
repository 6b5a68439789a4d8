"""Networks over tiles give what they give for the whole image; layers against their definitions."""

import numpy as np
import pytest

from gridloom.operators import chunks
from gridloom.plans import network

SIZES = {1: (72, 48), 2: (32, 80)}
NETS = {
    "fast": network.fast_road_net((4, 6)), "unet": network.u_net((4, 5, 6)), "compact": network.compact(3, 5, 2, 2), "leaky": network.compact(3, 4, 1, 3, "leakyrelu"),
}


def random_weights(net, seed=0):
    rng = np.random.default_rng(seed)
    return {k: (np.abs(rng.normal(1, 0.2, s)) if "running_var" in k else rng.normal(0, 0.4, s)).astype(np.float32) for k, s in net.shapes.items()}


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(1)
    arrays = {k: rng.random((3, *s)).round(3) for k, s in SIZES.items()}
    rows = [(k, r, c, *map(float, a[:, r, c])) for k, a in arrays.items() for r in range(a.shape[1]) for c in range(a.shape[2])]
    pixels = spark.createDataFrame(rows, "raster_id long, r int, c int, red double, green double, blue double")
    scenes = spark.createDataFrame([(k, w, h) for k, (h, w) in SIZES.items()], "raster_id long, width int, height int")
    return arrays, {t: chunks.from_pixels(pixels, scenes, ("red", "green", "blue"), t) for t in (16, 32)}


def test_layers_by_their_definitions():
    rng = np.random.default_rng(2)
    x, w, b = rng.normal(size=(2, 3, 5, 6)), rng.normal(size=(4, 3, 3, 3)), rng.normal(size=4)
    got = network.convolved(x, w, b)
    for i, o, r, c in np.ndindex(2, 4, 5, 6):
        want = b[o] + sum(w[o, k, p, q] * x[i, k, r + p - 1, c + q - 1] for k in range(3) for p in range(3) for q in range(3) if 0 <= r + p - 1 < 5 and 0 <= c + q - 1 < 6)
        assert abs(got[i, o, r, c] - want) < 1e-9
    t = rng.normal(size=(3, 4, 2, 2))
    up = network.transposed(x, t, b)
    for i, o, r, c in np.ndindex(2, 4, 10, 12):
        assert abs(up[i, o, r, c] - b[o] - sum(t[k, o, r % 2, c % 2] * x[i, k, r // 2, c // 2] for k in range(3))) < 1e-9
    pool = network.pooled(x)
    assert pool.shape == (2, 3, 2, 3) and pool[1, 2, 1, 2] == x[1, 2, 2:4, 4:6].max()
    s = rng.normal(size=(1, 8, 2, 3))
    out = network.shuffled(s, 2)
    assert out.shape == (1, 2, 4, 6) and all(out[0, k, r, c] == s[0, 4 * k + 2 * (r % 2) + c % 2, r // 2, c // 2] for k, r, c in np.ndindex(2, 4, 6))
    w = {"n.weight": np.array([2.0]), "n.bias": np.array([1.0]), "n.running_mean": np.array([3.0]), "n.running_var": np.array([4.0])}
    assert np.allclose(network.normalised(np.full((1, 1, 1, 1), 7.0), w, "n"), 2 * (7 - 3) / np.sqrt(4 + 1e-5) + 1)


@pytest.mark.parametrize("name", NETS)
def test_same_as_the_whole_image(images, name):
    arrays, tiled = images
    net = NETS[name]
    weights = random_weights(net)
    out = chunks.to_pixels(network.applied(tiled[32 if net.reach > 16 else 16], net, weights), tuple(f"b{k}" for k in range(net.bands))).collect()
    for k, a in arrays.items():
        h, w = a.shape[1:]
        padded = np.pad(a, ((0, 0), (0, -h % net.stride), (0, -w % net.stride)), mode="reflect").astype(np.float32)
        want = net.forward(padded[None], weights)[0][:, : h * net.scale, : w * net.scale]
        got = np.full(want.shape, np.nan)
        for r in out:
            if r["raster_id"] == k:
                got[:, r["r"], r["c"]] = [r[f"b{i}"] for i in range(net.bands)]
        assert np.abs(got - want).max() < 1e-4 and want.std() > 1e-3


def test_sizes_of_the_known_networks():
    """Weights of the networks as they are commonly built, and that a name that is not known gets the first."""
    count = lambda net: sum(int(np.prod(s)) for k, s in net.shapes.items() if "running" not in k)
    assert count(network.network("unet")) == 31_043_521 and count(network.network("something")) == 31_043_521
    assert network.network("compact").shapes["body.34.weight"] == (48, 64, 3, 3) and network.network("fast").shapes["decoder.0.weight"] == (64, 32, 2, 2)


def test_weights_from_a_table(spark, tmp_path, monkeypatch):
    net = NETS["fast"]
    weights = random_weights(net)
    rows = [(k, list(w.shape), w.ravel().tolist()) for k, w in weights.items()]
    table = spark.createDataFrame([*rows, ("other", [1], [1.0])], "key string, shape array<int>, w array<double>")
    network.saved(table, str(tmp_path / "w"))
    back = network.weights_of(spark.read.parquet(str(tmp_path / "w")), net)
    assert back.keys() == weights.keys() and all((back[k] == weights[k]).all() for k in weights)
    with pytest.raises(ValueError, match="encoder.0.bias"):
        network.weights_of(table.filter("key <> 'encoder.0.bias'"), net)
    monkeypatch.setattr(network, "MOST_WEIGHTS", 10)
    with pytest.raises(ValueError, match="more than"):
        network.weights_of(table, net)
    with pytest.raises(ValueError, match="multiple"):
        network.applied(chunks.Chunks(table, chunks.Form(31)), net, weights)
