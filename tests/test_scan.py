"""Histories in blocks against the plain recursions, with one cell that holds most rows."""

import random

import pytest

from geoblend.operators import scan, state


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(8)
    days = {"hot": sorted(rng.sample(range(-200, 3000), 1500)), "one": [7], "two": [-5, 900], "edge": [15, 16, 31, 32, 33], "few": sorted(rng.sample(range(100), 20))}
    rows = [(c, d, None if rng.random() < 0.3 else rng.gauss(0, 2), rng.gauss(0, 1), 0.1 + rng.random()) for c, ds in days.items() for d in ds]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "grid_id string, day int, value double, prior double, var double").repartition(4)


@pytest.mark.parametrize("block", [1, 16, 256, 100_000])
def test_blocks_equal_the_filter(history, block):
    want = {(r["grid_id"], r["day"]): list(r)[2:] for r in state.random_walk_filter(history).collect()}
    got = {(r["grid_id"], r["day"]): list(r)[2:] for r in scan.long_random_walk_filter(history, block=block).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("block", [16, 256])
def test_blocks_equal_the_smoother(history, block):
    df = history.filter("value is not null").selectExpr("grid_id", "day", "value AS mean", "var")
    want = {(r["grid_id"], r["day"]): list(r)[2:] for r in state.decay_smoother(df).collect()}
    out = scan.long_decay_smoother(df, block=block)
    assert out.columns == ["grid_id", "day", "mean", "var", "smooth_mean", "smooth_var"]
    got = {(r["grid_id"], r["day"]): list(r)[2:] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_no_rows(history):
    assert scan.long_random_walk_filter(history.limit(0)).collect() == []
