"""Stencils over tiles, joins over the meridian and with any keys, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoblend.operators import covariates, spatial, tiles


def test_stencil_sees_the_rim(spark):
    """Sums of 7 x 7 pixels on tiles of 4 with holes, negative rows, two days."""
    rng = random.Random(1)
    have = {(d, r, c): rng.random() for d in (0, 1) for r in range(-9, 14) for c in range(-3, 9) if rng.random() < 0.7}
    df = spark.createDataFrame([(*k, v, "clash") for k, v in have.items()], "day int, row int, col int, value double, tile string").repartition(4)

    def total(block, row, col):
        x = np.nan_to_num(block)
        return [sum(x[i : i + 4, j : j + 4] for i in range(7) for j in range(7)), np.where(block[3:7, 3:7] > 0.5, 1.0, np.nan)]

    got = tiles.stencil(tiles.tiled(df, ["day"], side=4), ["day"], 3, ["total", "high"], total, 4).collect()
    assert {(r["day"], r["row"], r["col"]) for r in got} == set(have)
    for r in got:
        near = sum(v for (d, i, j), v in have.items() if d == r["day"] and abs(i - r["row"]) <= 3 and abs(j - r["col"]) <= 3)
        assert r["total"] == pytest.approx(near) and r["high"] == (1.0 if have[r["day"], r["row"], r["col"]] > 0.5 else None)
    with pytest.raises(ValueError):
        tiles.stencil(tiles.tiled(df, ["day"], side=4), ["day"], 5, ["x"], total, 4)


def test_smoothing_over_tile_edges(spark):
    rng = random.Random(2)
    n, m = 70, 130
    have = {(r, c): None if rng.random() < 0.1 else rng.random() for r in range(n) for c in range(m) if rng.random() < 0.9 or (r, c) == (n - 1, m - 1)}
    df = spark.createDataFrame([(*k, v) for k, v in have.items()], "row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in spatial.gaussian_smooth(df).collect()}
    med = float(np.median([v for v in have.values() if v is not None]))
    full = {k: med if v is None else v for k, v in have.items()}
    w = [math.exp(-0.5 * (d / 0.6) ** 2) for d in range(-2, 3)]
    turned = lambda v, top: -v - 1 if v < 0 else 2 * top + 1 - v if v > top else v
    assert set(got) == set(have)
    for (r, c), v in got.items():
        hits = [(w[i + 2] * w[j + 2], full.get((turned(r + i, n - 1), turned(c + j, m - 1)))) for i in range(-2, 3) for j in range(-2, 3)]
        assert v == pytest.approx(sum(x * y for x, y in hits if y is not None) / sum(x for x, y in hits if y is not None))


def test_upwind_stencil_equals_pairs(spark):
    rng = random.Random(3)
    places = [(f"{r}_{c}", r, c, 53.0 + 0.001 * r, -6.0 + 0.0015 * c) for r in range(40) for c in range(80) if rng.random() < 0.5] + [("far", 900, 900, 53.9, -4.65)]
    cells = spark.createDataFrame(places, "grid_id string, r int, c int, latitude double, longitude double")
    traffic = spark.createDataFrame([(p[0], rng.choice([None, 0.0, rng.random() * 50])) for p in places], "grid_id string, traffic double")
    plain = {r["grid_id"]: list(r)[1:] for r in covariates.upwind_sums(cells, traffic, 1.1).collect()}
    got = {r["grid_id"]: list(r)[1:] for r in covariates.upwind_on_grid(cells, traffic, (0.001, 0.0015), 1.1).collect()}
    assert set(got) == set(plain) and "far" not in got
    for k, v in plain.items():
        assert got[k] == pytest.approx(v)


def test_radius_over_the_meridian(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-80, 80) if i % 2 else 10 + rng.uniform(-0.02, 0.02), ((180 + rng.uniform(-0.05, 0.05)) + 180) % 360 - 180) for i in range(300)]
    pts += [(1000, 0.0, 179.999), (1001, 0.0, -179.999), (1002, 0.0, 180.0), (1003, 0.0, -180.0)]
    df = spark.createDataFrame(pts, "k int, latitude double, longitude double")
    got = {(r["k"], r["other_k"]): r["km"] for r in spatial.radius_join(df, df, 5.0).collect()}
    want = {}
    for i, a, b in pts:
        for j, c, d in pts:
            gap = (d - b + 180) % 360 - 180
            km = math.hypot((c - a) * 111.32, gap * 111.32 * math.cos(math.radians(a)))
            if 1e-9 < km <= 5:
                want[i, j] = km
    assert {(1000, 1001), (1001, 1000)} <= set(got) and set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_nearest_with_repeated_and_null_keys(spark):
    points = spark.createDataFrame([(7, 10.0, 10.0), (8, 53.0, -6.0)], "grid_id int, latitude double, longitude double")
    rows = [(1, 53.0, -6.001), (1, 10.0, 10.0), (None, 52.0, -6.0), (None, None, 3.0), (1, 10.0, 10.0)]
    q = spark.createDataFrame(rows, "q int, latitude double, longitude double")
    got = sorted(((r["q"], r["latitude"], r["near_id"]) for r in spatial.nearest_join(q, points, (0.01, 0.01), []).collect()), key=str)
    assert got == sorted([(1, 53.0, 8), (1, 10.0, 7), (None, 52.0, 8), (None, None, None), (1, 10.0, 7)], key=str)
