"""Kernels of many items: work dealt out, kernels formed together against their definitions one by one."""

import math

import numpy as np

from gridloom.plans import items


def test_items_of_one_file_are_dealt_out(spark):
    found = items.kernels(spark.range(40).withColumnRenamed("id", "raster_id").coalesce(1))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = {(r["item"], r["stage"]): np.array(r["kernel"]) for r in found.collect()}
    assert set(rows) == {(i, k) for i in range(40) for k in (1, 2, 3)} and all(len(x) == 441 and math.isclose(x.sum(), 1) for x in rows.values())
    for i in range(40):  # whatever items share a batch, an item's kernels are its own
        rng = np.random.default_rng([0, i])
        if rng.random() < 0.8:
            side = int(rng.choice(items.SIDES))
            last = np.pad(items.low_pass(rng.uniform(math.pi / 3, math.pi), side), (21 - side) // 2)
        else:
            last = np.eye(441)[220]
        for stage, want in ((1, items.blur_kernel(rng)), (2, items.blur_kernel(rng)), (3, last)):
            assert np.allclose(rows[i, stage], want.ravel(), rtol=0, atol=1e-15)


def bessel(x):
    t = (np.arange(4096) + 0.5) * math.pi / 4096
    return np.cos(t - x * np.sin(t)).mean()


def one(side, kind, power, sx, sy, cos, sin):
    """A kernel place by place."""
    k, h = np.zeros((21, 21)), side // 2
    for y in range(-h, h + 1):
        for x in range(-h, h + 1):
            d, square = math.hypot(x, y), ((x * cos + y * sin) / sx) ** 2 + ((-x * sin + y * cos) / sy) ** 2
            if kind == items.LOW_PASS:
                k[10 + y, 10 + x] = power * bessel(power * d) / (2 * math.pi * d) if d else power**2 / (4 * math.pi)
            else:
                k[10 + y, 10 + x] = 1 / (1 + square**power) if kind == items.PLATEAU else math.exp(-0.5 * square**power)
    return k / k.sum()


def test_kernels_formed_together_are_those_of_their_formulas():
    shapes = [items.drawn(np.random.default_rng(i)) for i in range(60)] + [(21, items.LOW_PASS, math.pi, 1.0, 1.0, 1.0, 0.0), (1, items.GAUSS, 1.0, 1.0, 1.0, 1.0, 0.0)]
    assert {s[1] for s in shapes} == {items.LOW_PASS, items.GAUSS, items.GENERALIZED, items.PLATEAU}
    for shape, k in zip(shapes, items.formed(shapes), strict=True):
        assert np.allclose(k, one(*shape), rtol=0, atol=1e-13)


def test_draws_are_those_of_numpy():
    """choice and uniform of the generator, taken apart: the same numbers and the same state after them."""
    for i in range(200):
        a, b = np.random.default_rng(i), np.random.default_rng(i)
        side, kind, power, sx, *_ = items.drawn(a)
        assert side == b.choice(items.SIDES)
        if b.random() < items.SINC:
            assert kind == items.LOW_PASS and power == b.uniform(math.pi / 3 if side < 13 else math.pi / 5, math.pi)
        else:
            family = items.FAMILIES[b.choice(len(items.FAMILIES), p=[p for _, p in items.FAMILIES])][0]
            assert kind == (items.PLATEAU if family.startswith("plateau") else items.GENERALIZED if family.startswith("generalized") else items.GAUSS)
            assert sx == b.uniform(*items.SIGMA)
            if family.endswith("aniso"):
                b.uniform(*items.SIGMA), b.uniform(-math.pi, math.pi)
            if kind != items.GAUSS:
                assert power == b.uniform(*(items.BETA_P if kind == items.PLATEAU else items.BETA_G))
        assert a.bit_generator.state == b.bit_generator.state
