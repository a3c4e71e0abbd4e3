"""Distance weights by the tree against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoblend.operators import farfield, spatial


def test_interpolation_is_exact_for_low_degrees():
    x = np.linspace(-1, 1, 30)
    w = farfield.interpolation(x, 8)
    for k in range(8):
        assert w @ farfield.nodes(8) ** k == pytest.approx(x**k)


def plain(cells, pts, power, scale):
    d = np.hypot((cells[:, None, 0] - pts[None, :, 0]) * scale[0], (cells[:, None, 1] - pts[None, :, 1]) * scale[1])
    w = d**-power
    return w.sum(axis=1), w @ pts[:, 2], w @ np.abs(pts[:, 2])


@pytest.mark.parametrize("power", [2.0, 1.0, 3.5])
def test_tree_sums_keep_the_bound(spark, power):
    rng = np.random.default_rng(3)
    pts = np.column_stack([np.concatenate([rng.random((3000, 2)), 0.2 + 0.01 * rng.normal(size=(1000, 2))]), rng.normal(size=4000)])
    cells = np.concatenate([rng.random((150, 2)) * 1.2 - 0.1, 0.2 + 0.02 * rng.normal(size=(50, 2))])
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(pts)], "ord int, latitude double, longitude double, value double")
    c = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cells)], "_id long, latitude double, longitude double")
    got = {r["_id"]: r for r in farfield.idw_sums(c, p, len(pts), power, 1e-12, (1.0, 0.6), leaf=20).collect()}
    w, v, size = plain(cells, pts, power, (1.0, 0.6))
    assert len(got) == len(cells) and not any(r["_hit"] for r in got.values())
    for i in range(len(cells)):
        assert abs(got[i]["_w"] - w[i]) < 1e-8 * w[i] and abs(got[i]["_wv"] - v[i]) < 1e-8 * size[i]


def test_work_grows_with_levels_not_points(spark):
    """Pairs a cell, with points or nodes: four times the points add a level of boxes at most."""
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((40, 2)))], "_id long, latitude double, longitude double")
    pairs = {}
    for n in (4_000, 16_000):
        p = spark.range(n).select(F.col("id").alias("ord"), F.rand(1).alias("latitude"), F.rand(2).alias("longitude"), F.lit(1.0).alias("value"))
        pairs[n] = farfield.idw_sums(cells, p, n, 2.0, 1e-12, (1.0, 1.0), q=6, leaf=60).agg(F.avg("_pairs")).first()[0]
    assert pairs[16_000] < pairs[4_000] + 27 * 36 + 9 * 60 and pairs[16_000] < 16_000 / 2, pairs


def test_a_strip_of_points_has_small_boxes(spark):
    """Points along a narrow strip: a cell meets few of them, however many they are; even places keep their depth."""
    rng = np.random.default_rng(6)
    pts = np.column_stack([rng.random(8000), 0.01 * rng.random(8000), rng.normal(size=8000)])
    cells = np.column_stack([rng.random(60), 0.01 * rng.random(60)])
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(pts)], "ord int, latitude double, longitude double, value double")
    c = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cells)], "_id long, latitude double, longitude double")
    got = {r["_id"]: r for r in farfield.idw_sums(c, p, len(pts), 2.0, 1e-12, (1.0, 1.0), leaf=20).collect()}
    w, v, size = plain(cells, pts, 2.0, (1.0, 1.0))
    assert all(abs(got[i]["_w"] - w[i]) < 1e-8 * w[i] and abs(got[i]["_wv"] - v[i]) < 1e-8 * size[i] for i in range(60))
    depth = farfield.tree_depth(8000, (1.0, 0.01), 1.0, 20)
    # Boxes of points and at most 27 boxes of nodes a level; with the depth of an even square (5) 3 boxes would hold 750 points.
    near = [np.sum(np.abs(np.floor(pts[:, :2] * 2**depth) - np.floor(cell * 2**depth)).max(axis=1) <= 1) for cell in cells]
    assert max(near) < 9 * 2 * 20 and depth > farfield.tree_depth(8000, (1.0, 1.0), 1.0, 20) == 5
    assert all(got[i]["_pairs"] < 9 * 2 * 20 + 27 * 144 * depth for i in range(60))
    for n in (100, 4_000, 16_000, 1_000_000):
        assert farfield.tree_depth(n, (1.0, 1.0), 1.0, 60) == max(0, int(np.ceil(np.log(n / 60) / np.log(4))))
    assert farfield.tree_depth(5_000, (0.0, 0.0), 1.0, 60) == 4


def test_idw_by_the_tree(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(rng.random((500, 3)))] + [(990, 0.25, 0.25, 9.0), (600, 0.25, 0.25, 7.0), (601, None, 0.2, 1.0)]
    grid = spark.createDataFrame([(f"g{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.random((40, 2)))] + [("hit", 0.25, 0.25), ("none", None, 0.1), (None, 0.5, 0.5), (None, 0.7, 0.5)], "grid_id string, latitude double, longitude double")
    points = spark.createDataFrame(pts, "ord int, latitude double, longitude double, value double")
    rows = lambda df: sorted((r["grid_id"] or "", r["latitude"] or 0.0, r["value"] if r["value"] is not None else -1.0) for r in df.collect())
    for options in ({}, {"km": 111.0, "exact": 1e-6, "default": 0.0}):
        whole, tree = rows(spatial.idw(grid, points, "grid_id", **options)), rows(spatial.idw(grid, points, "grid_id", limit=7, **options))
        assert [x[:2] for x in tree] == [x[:2] for x in whole] and [x[2] for x in tree if x[0] != "none"] == pytest.approx([x[2] for x in whole if x[0] != "none"], rel=1e-7)
