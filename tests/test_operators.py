import math

import pytest
from pyspark.sql import functions as F

from geoblend.operators import calibrate, clean, daily, metrics, scaling, spatial, splits, state
from geoblend.sources import tables


def test_map_source_fills_absent_and_requires_some(spark):
    df = spark.createDataFrame([("a", 53.0, -6.0, "2024-01-01", "1.5"), ("b", float("nan"), -6.0, "bad", "x")], "grid_id string, latitude double, longitude double, timestamp string, epa_no2 string")
    out = tables.map_source(df, tables.Mapping(sources={"station": "epa_no2", "satellite": "none"}))
    assert [tuple(r[c] for c in ("station", "satellite")) for r in out.orderBy("grid_id").collect()] == [(1.5, None), (None, None)]
    assert tables.drop_invalid_keys(out).count() == 1
    with pytest.raises(ValueError):
        tables.map_source(df, tables.Mapping(sources={"satellite": "none"}))
    with pytest.raises(ValueError):
        tables.map_source(df.drop("latitude"), tables.Mapping())


def test_geojson_centroid(spark, tmp_path):
    (tmp_path / "g.json").write_text("""{"features": [{"properties": {"grid_id": " u "}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,1],[0,0]]]}},
      {"properties": {"grid_id": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[2,2],[4,2],[4,4],[2,4],[2,2]]]]}}]}""")
    rows = {r["grid_id"]: (r["longitude"], r["latitude"]) for r in tables.with_centroid(tables.read_geojson_cells(spark, str(tmp_path / "g.json"))).collect()}
    assert rows["u"] == pytest.approx((0.5, 0.5)) and rows["m"] == pytest.approx((3.0, 3.0))


def test_sinks_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int")
    path = str(tmp_path / "out")
    assert tables.write_table(df, path, by=["source"]) and not tables.write_table(df.limit(1), path, by=["source"], resume=True)
    assert spark.read.parquet(path).count() == 2
    assert tables.write_table(df, path + "c", "csv") and spark.read.csv(path + "c", header=True).columns == ["source", "v"]


def test_outliers_need_points_and_spread(spark):
    few = spark.createDataFrame([(float(i),) for i in range(5)] + [(1e6,)], "v double")
    assert not any(r["is_outlier"] for r in clean.treat_outliers(few, "v", clean.outlier_bounds(few, "v")).collect())
    flat = spark.createDataFrame([(1.0,)] * 30 + [(50.0,)], "v double")
    assert not any(r["is_outlier"] for r in clean.treat_outliers(flat, "v", clean.outlier_bounds(flat, "v", "robust")).collect())
    many = spark.createDataFrame([(float(i),) for i in range(40)] + [(1e6,), (None,)], "v double")
    bounds = clean.outlier_bounds(many, "v")
    assert sum(r["is_outlier"] for r in clean.treat_outliers(many, "v", bounds).collect()) == 1
    assert clean.treat_outliers(many, "v", bounds, "drop").count() == 41
    assert clean.treat_outliers(many, "v", bounds, "nan").filter("v is null").count() == 2


def test_point_metrics_known_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = df.agg(*metrics.point_metrics(F.col("y"), F.col("p"))).first()
    assert r["rmse"] == pytest.approx(math.sqrt(2 / 3)) and r["mae"] == pytest.approx(2 / 3) and r["bias"] == pytest.approx(0) and r["r2"] == pytest.approx(0)


def test_calibrated_predictions_cover(spark):
    df = spark.range(10_000).select(F.randn(3).alias("y"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
    r = metrics.evaluate(df).first()
    assert abs(r["coverage_90"] - 0.9) < 0.02 and abs(r["coverage_50"] - 0.5) < 0.02
    assert r["coverage_50"] < r["coverage_80"] < r["coverage_90"] < r["coverage_95"]
    assert metrics.ks_uniform(metrics.scored(df)).first()["ks"] < 0.05


def test_no_uncertainty_gives_null_scores(spark):
    df = spark.createDataFrame([(1.0, 1.5, 0.0), (2.0, 2.5, None)], "y double, mean double, std double")
    r = metrics.scored(df).agg(F.avg("nll").alias("nll"), F.avg("crps").alias("crps")).first()
    assert r["nll"] is None and r["crps"] is None


def test_identity_calibration_under_ten_points(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i) for i in range(9)], "x double, y double")
    r = calibrate.linear_calibration(df, "x", "y").first()
    assert (r["slope"], r["intercept"], r["r2"]) == (1.0, 0.0, None)
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(10)], "x double, y double")
    r = calibrate.linear_calibration(df, "x", "y").first()
    assert r["slope"] == pytest.approx(3) and r["intercept"] == pytest.approx(1)


def test_linear_fit_and_thinning(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 2.0 * i - (i * i % 7) + 5.0) for i in range(30)], "a double, b double, y double")
    assert calibrate.fit_linear(df, ["a", "b"], "y") == pytest.approx([5, 2, -1], abs=1e-6)
    rep = spark.createDataFrame([("d", f"c{i:02d}", 1.0) for i in range(20)], "date string, grid_id string, v double")
    assert [r["grid_id"] for r in calibrate.thin_repeats(rep, "v").collect()] == ["c00"]
    assert sorted(r["grid_id"] for r in calibrate.thin_repeats(rep, "v", keep=3).collect()) == ["c00", "c01", "c02"]


def test_scalers_handle_single_location(spark):
    df = spark.createDataFrame([(53.0, -6.0, 1.0, 5.0), (53.0, -6.0, 1.0, 5.0)], "latitude double, longitude double, day double, s double")
    r = scaling.scaler_table(df, ["s"]).first()
    assert (r["scale"], r["day_range"], r["s_std"]) == (1.0, 1.0, 1.0)


def test_splits_cover_and_hold_stations(spark):
    df = spark.range(600).select(F.concat(F.lit("c"), (F.col("id") % 30).cast("string")).alias("grid_id"), F.col("id").alias("date"), F.lit(1.0).alias("station"))
    for out in (splits.spatial_split(df), splits.station_split(df, "station"), splits.exact_split(df, ["grid_id", "date"])):
        assert out.count() == 600 and out.filter("split is null").count() == 0
    held = splits.station_split(df, "station").filter("split = 'test'").select("grid_id").distinct().count()
    assert held == 6
    assert splits.exact_split(df, ["grid_id", "date"]).filter("split = 'train'").count() == 420
    one = df.filter("grid_id = 'c0'")
    assert splits.holdout_cells(one, "station").count() == 0
    forward = splits.temporal_folds(df.withColumn("ts", F.col("date")), mode="forward")
    late = forward.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("b"))
    assert all(r["a"] < r["b"] for r in late.collect())


@pytest.mark.parametrize("base", [0.0, 53.0, 70.0, 88.0])
def test_radius_against_all_pairs(spark, base):
    """Points over several bands of latitude, also across the equator."""
    import random

    rng = random.Random(base)
    pts = [(f"p{i}", base - 1.5 + rng.random() * 3, -6 + rng.random() * 3) for i in range(250)]
    df = spark.createDataFrame(pts, "grid_id string, latitude double, longitude double")

    def km(a, b, lat):
        return math.hypot((b[2] - a[2]) * 111.320 * math.cos(math.radians(lat)), (b[1] - a[1]) * 111.320)

    for radius, scale_lat in ((30.0, None), (2.7, None), (25.0, 53.0)):
        pairs = spatial.radius_join(df, df, radius, scale_lat).select("grid_id", "other_grid_id").collect()
        want = {(a[0], b[0]) for a in pts for b in pts if 0 < km(a, b, a[1] if scale_lat is None else scale_lat) <= radius}
        assert len(pairs) == len(want) and {tuple(r) for r in pairs} == want


def test_nearest_against_all_pairs(spark):
    """Near and far queries, clusters of points, ties, a missing place, no points at all."""
    import random

    rng = random.Random(2)
    pts = [(f"p{i}", 53 + rng.random() * 0.05, -6 + rng.random() * 0.05, float(i)) for i in range(120)] + [(f"r{i}", -40 + rng.random() * 80, rng.random() * 170, 1.0) for i in range(60)]
    pts += [("t2", 10.0, 11.0, 0.0), ("t1", 10.0, 9.0, 0.0), ("z", None, 1.0, 0.0)]
    df = spark.createDataFrame(pts, "grid_id string, latitude double, longitude double, v double")
    asked = [(f"q{i}", 53 + rng.random() * 0.08, -6 + rng.random() * 0.08) for i in range(40)] + [(f"f{i}", -80 + rng.random() * 160, -170 + rng.random() * 340) for i in range(60)] + [("tie", 10.0, 10.0), ("none", None, 3.0)]
    q = spark.createDataFrame(asked, "q string, latitude double, longitude double")
    got = {r["q"]: (r["near_id"], r["v"]) for r in spatial.nearest_join(q, df, (0.004, 0.004), ["v"]).collect()}
    known = [p for p in pts if p[1] is not None]
    best = {n: min(known, key=lambda p: (math.hypot(p[1] - la, p[2] - lo), p[0])) for n, la, lo in asked if la is not None}
    assert got == {n: (p[0], p[3]) for n, p in best.items()} | {"none": (None, None)} and got["tie"][0] == "t1"
    empty = spatial.nearest_join(q, df.limit(0), (0.004, 0.004), ["v"]).collect()
    assert len(empty) == len(asked) and all(r["near_id"] is None for r in empty)
    near = {r["q"]: r["v"] for r in spatial.nearest_join(q, df, (0.004, 0.004), ["v"], most=0.05, default=-1.0).collect()}
    gap = lambda n, la, lo: math.hypot(best[n][1] - la, best[n][2] - lo)
    assert all(near[n] == (best[n][3] if la is not None and gap(n, la, lo) <= 0.05 else -1.0) for n, la, lo in asked)


def test_idw_in_blocks(spark):
    import random

    rng = random.Random(5)
    grid = spark.createDataFrame([(f"g{i}", rng.random(), rng.random()) for i in range(30)] + [("hit", 0.25, 0.25)], "grid_id string, latitude double, longitude double")
    points = spark.createDataFrame([(i, rng.random(), rng.random(), rng.random()) for i in range(50)] + [(99, 0.25, 0.25, 9.0), (60, 0.25, 0.25, 7.0), (61, None, 0.2, 1.0)], "ord int, latitude double, longitude double, value double")
    for options in ({}, {"km": 111.0, "exact": 1e-6, "default": 0.0}):
        whole = {r["grid_id"]: r["value"] for r in spatial.idw(grid, points, "grid_id", **options).collect()}
        parts = {r["grid_id"]: r["value"] for r in spatial.idw(grid, points, "grid_id", limit=7, **options).collect()}
        assert parts == pytest.approx(whole) and whole["hit"] == 7.0


def test_nearest_days_and_classes(spark):
    from geoblend.functions.scalars import no2_class

    days = lambda *x: spark.createDataFrame([(d,) for d in x], "date string").select(F.to_date("date").alias("date"))
    asked = days("2024-01-01", "2024-01-04", "2024-01-05", "2024-01-09")
    got = {str(r["date"])[8:]: str(r["nearest_day"])[8:] for r in daily.nearest_days(asked, days("2024-01-03", "2024-01-05", "2024-01-05", "2024-01-06")).collect()}
    assert got == {"01": "03", "04": "03", "05": "05", "09": "06"}
    assert daily.nearest_days(asked, days().limit(0)).collect() == []
    values = spark.createDataFrame([(-1.0,), (0.0,), (4.99,), (5.0,), (39.9,), (40.0,), (None,)], "v double")
    assert [r[0] for r in values.select(no2_class(F.col("v"))).collect()] == [-1, 0, 0, 1, 8, 9, None]


def test_idw_exact_and_within_range(spark):
    grid = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.5, 0.5), ("c", 0.9, 0.1)], "grid_id string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 0.0, 0.0, 7.0), (2, 0.0, 0.0, 9.0), (3, 1.0, 1.0, 1.0)], "ord int, latitude double, longitude double, value double")
    v = {r["grid_id"]: r["value"] for r in spatial.idw(grid, points, "grid_id").collect()}
    assert v["a"] == 7.0 and all(1.0 <= x <= 9.0 for x in v.values())


def test_grid_order_and_missing_corner(spark):
    g = spatial.grid_from_bounds(spark, 53.0, 53.01, -6.0, -5.99, 300.0).collect()
    n_lon = max(r["grid_j"] for r in g) + 1
    assert all(r["k"] == r["grid_i"] * n_lon + r["grid_j"] for r in g)
    raster = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0), (2, 0, None), (2, 1, 1.0)], "row int, col int, value double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 1.5)], "k int, x double, y double")
    assert {r["k"]: r["value"] for r in spatial.bilinear_sample(pts, raster, "k", F.col("x"), F.col("y")).collect()} == {1: 4.0, 2: None}


def test_filter_against_plain_loop(spark):
    rows = [("c", 0, None, 10.0), ("c", 1, 12.0, 10.0), ("c", 4, None, 10.0), ("c", 5, 8.0, 10.0)]
    got = [(r["day"], r["mean"], r["var"]) for r in state.random_walk_filter(spark.createDataFrame(rows, "grid_id string, day int, value double, prior double")).orderBy("day").collect()]
    m, p, want = 10.0, 2.0, [(0, 10.0, 2.0)]
    for _, d, v, _ in rows[1:]:
        p += 0.5
        if v is not None:
            k = p / (p + 2.0)
            m, p = m + k * (v - m), (1 - k) * p
        want.append((d, m, p))
    assert [pytest.approx(w) for w in want] == got


def test_smoother_single_day_passes_through(spark):
    df = spark.createDataFrame([("a", 3, 1.5, 0.2)], "grid_id string, day int, mean double, var double")
    r = state.decay_smoother(df).first()
    assert (r["smooth_mean"], r["smooth_var"]) == (1.5, 0.2)


def test_daily_frame(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "grid_id string")
    src = spark.createDataFrame([("a", "2024-01-01", 2.0)], "grid_id string, date string, traffic double")
    out = daily.merge_daily(daily.cell_frame(cells, daily.date_union([src])), {"traffic": src})
    assert sorted((r["grid_id"], r["traffic"]) for r in out.collect()) == [("a", 2.0), ("b", 0.0)]


def test_grids(spark):
    centre = spatial.grid_from_centre(spark, 53.0, -6.0, 4.2, 2.2, 500.0).collect()
    assert len(centre) == 5 * 9 and all(abs(r["latitude"] - 53.0) * 111.32 <= 1.1 + 1e-9 and abs(r["longitude"] + 6.0) * 111.32 * math.cos(math.radians(53.0)) <= 2.1 + 1e-9 for r in centre)
    grid = spark.createDataFrame([(i, j, float(10 * i + j), 0.0, 0.0) for i in range(3) for j in range(4)], "grid_i int, grid_j int, value double, latitude double, longitude double")
    q = spark.createDataFrame([(1, 0.9, 2.2), (2, -5.0, 9.0), (3, 1.4, 0.4)], "q int, latitude double, longitude double")
    got = {r["q"]: r["value"] for r in spatial.nearest_on_grid(q, grid, (0.0, 0.0), (1.0, 1.0), (3, 4)).collect()}
    assert got == {1: 12.0, 2: 3.0, 3: 10.0}


def test_cluster_folds(spark):
    """Whole cells stay together, each in the fold of the nearest centre; space-time folds are cluster and time block."""
    rows = [(f"{k}-{i}", d, 10.0 * k + 0.1 * i, 5.0 * k) for k in range(3) for i in range(4) for d in range(6)]
    df = spark.createDataFrame(rows, "grid_id string, ts int, latitude double, longitude double")
    fold = {(r["grid_id"], r["ts"]): r["fold"] for r in splits.spatial_folds(df, 3).collect()}
    by_group = {k: {f for (g, _), f in fold.items() if g.startswith(f"{k}-")} for k in range(3)}
    assert all(len(f) == 1 for f in by_group.values()) and set.union(*by_group.values()) == {0, 1, 2}
    both = {(r["grid_id"], r["ts"]): r["fold"] for r in splits.space_time_folds(df, 3, 3).collect()}
    assert both.keys() == fold.keys() and all(both[k] == fold[k] * 3 + k[1] // 2 for k in both)


def test_one_station_out_in_long_form(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None)], "grid_id string, station double")
    for limit in (10, 0):
        long = splits.leave_one_station_out(df, "station", limit=limit)
        assert sorted((r["fold"], r["grid_id"], r["role"]) for r in long.collect()) == sorted((f, g, "test" if f == g else "train") for f in "ab" for g in "aabc")
    means = {r["fold"]: (r["n"], r["n_test"], r["train_mean"]) for r in splits.left_out_means(df, "station").collect()}
    assert means == {"a": (3, 2, 5.0), "b": (3, 1, 1.5)}


def test_export_by_source_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0, None, 3.0), ("b", "2024-01-01", None, 2.0, 4.0)], "grid_id string, date string, station double, satellite double, lur double")
    long = daily.long_export(df, ["station", "satellite"], ["grid_id", "date"], "lur")
    tables.write_table(long, str(tmp_path / "by"), by=["source"])
    back = spark.read.parquet(str(tmp_path / "by"))
    assert sorted((r["source"], r["grid_id"], r["value"]) for r in back.collect()) == [("lur", "a", 3.0), ("lur", "b", 4.0), ("satellite", "b", 2.0), ("station", "a", 1.0)]
    tables.write_table(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_rounded_coordinates_equal_the_sql_far_north(spark, tmp_path):
    """Latitudes whose printed third digit is a 5 although the double lies below the tie."""
    import duckdb

    from geoblend.catalog.registry import ORACLES, QUERIES

    keys = [120 * r + c for r in range(4250, 4900, 5) for c in (0, 10, 50)]
    spark.createDataFrame([(k, 10.0) for k in keys], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    events = spark.createDataFrame([(k // 10, "purchase", float(k % 7)) for k in keys], "user_id long, event_type string, value double")
    events.withColumn("ts", F.lit("2024-01-02 03:00:00").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for t in ("customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["rounded_coordinates"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["rounded_coordinates"]).fetchall()) and len(got) > 100


@pytest.mark.parametrize("base,scale_lat", [(0.0, None), (53.0, None), (88.7, None), (90.6, None), (53.0, 53.0)])
def test_radius_sums_against_all_pairs(spark, monkeypatch, base, scale_lat):
    """In many tasks and steps, over the 180th meridian, with a dense spot; no row of a pair is made."""
    import random

    import numpy as np

    monkeypatch.setattr(spatial, "TASK_POINTS", 50)
    monkeypatch.setattr(spatial, "AT_ONCE", 700)
    rng = random.Random(base)
    pts = [(f"p{i}", base - 0.4 + rng.random() * 0.8, rng.choice([-6.0, 179.8]) + rng.random() * 0.4, rng.random()) for i in range(200)] + [(f"q{i}", base, -6.0 + 1e-6 * i, 2.0) for i in range(60)]
    pts = [(k, a, b - 360 if b > 180 else b, v) for k, a, b, v in pts]
    df = spark.createDataFrame([*pts, ("none", None, 3.0, 1.0)], "grid_id string, latitude double, longitude double, v double")
    out = spatial.radius_sums(df, df, 11.0, ["d", "v"], lambda row, east, north, d, v, rows: [np.bincount(row, d, rows), np.bincount(row, v, rows)], "v", scale_lat)
    assert out.rdd.getNumPartitions() == 6  # by the points, however few bytes they are
    want = {}
    for k, a, b, _ in pts:
        for _, c, d, v in pts:
            km = math.hypot(((d - b + 180) % 360 - 180) * 111.32 * math.cos(math.radians(a if scale_lat is None else scale_lat)), (c - a) * 111.32)
            if 1e-9 < km <= 11:
                n, total, s = want.get(k, (0, 0.0, 0.0))
                want[k] = n + 1, total + km, s + v
    got = {r["grid_id"]: (r["n"], r["d"], r["v"]) for r in out.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6)
