"""Maps of the catalog cover every cell, with readings or without."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoblend.catalog.registry import QUERIES
from geoblend.operators import field

KEYS, USERS, DAYS = 60, 6, 12  # users are every tenth cell


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The tables' folder and the readings (key, kind, day, value): 6 of 60 cells have some, one customer has no key."""
    path, rng, readings = str(tmp_path_factory.mktemp("maps")), np.random.default_rng(4), []
    for user in range(USERS):
        for day in range(DAYS):
            for kind in ("purchase", "view", "click"):
                if rng.random() < 0.8:
                    readings.append((user, kind, day, float(20 + 60 * rng.random())))
    customers = [(k, float(3000 + 100 * (k % 30))) for k in range(KEYS)] + [(None, 1.0)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").write.parquet(f"{path}/customer.parquet")
    events = [(u, kind, datetime.datetime(2024, 1, 1 + d, 5), v) for u, kind, d, v in readings]
    spark.createDataFrame(events, "user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{path}/events.parquet")
    return path, [(10 * u, kind, d, v) for u, kind, d, v in readings]


def test_covariate_maps_cover_every_cell_and_day(spark, tables, monkeypatch):
    """More days than ten, cells without readings by their own wind and traffic, not by the mean of those that have some."""
    path, readings = tables
    seen, plain = [], field.predict
    monkeypatch.setattr(field, "predict", lambda rows, *a, **k: seen.append(rows) or plain(rows, *a, **k))
    got = {(r["grid_id"], r["day"]): r for r in QUERIES["covariate_maps"](spark, path).collect()}
    assert set(got) == {(f"0_{c}", d) for c in range(KEYS) for d in range(DAYS)}
    for day in range(DAYS):
        n = {kind: len({k for k, x, d, _ in readings if (x, d) == (kind, day)}) for kind in ("purchase", "view")}
        assert all((got[f"0_{c}", day]["n_obs"], got[f"0_{c}", day]["n_satellite"]) == (n["purchase"], n["view"]) for c in range(KEYS))
    assert all(math.isfinite(r[c]) for r in got.values() for c in ("mean", "std", "lower_95", "upper_95"))

    unit = lambda tag, c, d: int(hashlib.md5(f"0_{c}|2024-01-{d + 1:02d}|{tag}".encode()).hexdigest()[:8], 16) / 2.0**32
    click = {k: np.mean([v for key, kind, _, v in readings if (key, kind) == (k, "click")]) for k in range(0, KEYS, 10)}

    def covariates(c, d):  # one row of cells, so all are due east or west
        km = lambda i: abs(i - c) * 0.0015 * 111.0 * math.cos(math.radians(53.25))
        side = lambda cells: sum(click.get(i, 1.0) / km(i) ** 2 for i in cells if 0 < km(i) <= 3.0)
        wind = sum(10 * unit(f"s{k}", c, d) * unit(f"f{k}", c, d) for k in range(8))
        return math.log1p(side(range(c + 1, KEYS)) * unit("f2", c, d) + side(range(c)) * unit("f6", c, d)), wind

    known = np.array([covariates(*at) for at in sorted({(k, d) for k, _, d, _ in readings})])
    mean, spread = known.mean(axis=0), known.std(axis=0)
    grid = {(r["grid_id"], r["day"]): (r["traffic_wind"], r["wind_speed"]) for r in seen[-1].select("grid_id", "day", "traffic_wind", "wind_speed").collect()}
    for c, d in ((5, 0), (37, 7), (59, 11), (10, 3)):
        assert grid[f"0_{c}", d] == pytest.approx(tuple((np.array(covariates(c, d)) - mean) / spread), abs=1e-9)


def test_field_export_covers_every_cell_and_day(spark, tables):
    """Cells without readings have the field and no observations; the others have theirs."""
    path, readings = tables
    got = {(r["grid_id"], r["day"]): r for r in QUERIES["field_export"](spark, path).collect()}
    assert set(got) == {(f"0_{c}", d) for c in range(KEYS) for d in range(DAYS)}
    for (cell, day), r in got.items():
        for name, kind in (("station", "purchase"), ("satellite", "view")):
            own = [v for k, x, d, v in readings if (f"0_{k}", x, d) == (cell, kind, day)]
            assert r[name] == (pytest.approx(np.mean(own), abs=1e-3) if own else None)
        assert r["lower_95"] < r["mean"] < r["upper_95"]
    # Of cells so far from the readings the field knows little more than the prior.
    assert got["0_55", 3]["std"] > got["0_50", 3]["std"]


def test_kriged_day_covers_every_cell(spark, tables):
    """The day with most stations, against the dense process at cells without readings too."""
    path, readings = tables
    got = {r["grid_id"]: r["mean"] for r in QUERIES["kriged_day"](spark, path).collect()}
    assert set(got) == {f"0_{c}" for c in range(KEYS)}
    days = [{k: [v for key, kind, d, v in readings if (key, kind, d) == (k, "purchase", day)] for k in range(0, KEYS, 10)} for day in range(DAYS)]
    best = max(days, key=lambda day: (sum(map(bool, day.values())), -days.index(day)))
    own = [(k, (np.mean(v) - 50) / 100) for k, v in best.items() if v]
    x = lambda keys: np.column_stack([np.zeros(len(keys)), np.array(keys) / (KEYS - 1), np.zeros(len(keys))])
    prior = lambda keys: (30 + np.array(keys) % 30 - 45.0) / 100
    f, at, value = field.Field(field.regular_points(2, 1), space=0.2), [k for k, _ in own], np.array([v for _, v in own])
    slope, shift = np.polyfit(prior(at), value, 1) if len(at) >= 5 else (None, None)
    assert slope is not None
    w = np.linalg.solve(f.cov(x(at), x(at)) + 0.09 * np.eye(len(at)), value - slope * prior(at) - shift)
    cells = list(range(KEYS))
    want = slope * prior(cells) + shift + f.cov(x(cells), x(at)) @ w
    assert [got[f"0_{c}"] for c in cells] == pytest.approx(list(want), abs=1e-4)
