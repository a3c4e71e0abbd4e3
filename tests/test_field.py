import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoblend.operators import field
from geoblend.sources.tables import Source


def rows_of(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    data = [(float(a), float(b), float(t), float(np.sin(4 * a) + 0.1 * rng.normal()), 0.2, "s" if i % 2 else "u", int(i % 4)) for i, (a, b, t) in enumerate(rng.random((n, 3)))]
    df = spark.createDataFrame(data, "x double, y double, t double, value double, prior double, source string, day int")
    return field.with_source(df, [Source("s", "s", 0.3), Source("u", "u", 0.5, 0.8, 0.1)])


def dense(rows, f, at):
    """Exact process with the inducing points at all rows: the reference result."""
    x = np.array([(r["x"], r["y"], r["t"]) for r in rows])
    a, s2 = np.array([r["slope"] for r in rows]), np.array([r["noise"] ** 2 for r in rows])
    r = np.array([q["value"] - q["intercept"] - q["slope"] * q["prior"] for q in rows])
    k = f.cov(x, x) * np.outer(a, a) + np.diag(s2)
    kx = f.cov(at, x) * a
    return kx @ np.linalg.solve(k, r), f.variance - np.einsum("ij,ji->i", kx, np.linalg.solve(k, kx.T))


def test_fit_equals_dense_process(spark):
    df = rows_of(spark)
    rows = df.collect()
    f = field.Field(np.array([(r["x"], r["y"], r["t"]) for r in rows]), jitter=1e-9)
    at = np.random.default_rng(5).random((15, 3))
    mean, var = field.fit(field.information_sums(df, f)[""], f).at(at)
    m, v = dense(rows, f, at)
    assert mean == pytest.approx(m, abs=1e-4) and var == pytest.approx(v, abs=1e-4)


def test_sums_do_not_depend_on_partitions_and_subtract(spark):
    df = rows_of(spark)
    f = field.Field(field.regular_points(3, 2))
    a, b = field.information_sums(df.repartition(1), f)[""], field.information_sums(df.repartition(7), f)[""]
    assert a.a == pytest.approx(b.a) and a.n == b.n == 40
    by = field.information_sums(df, f, key="source")
    assert (a - by["s"]).a == pytest.approx(by["u"].a)


def test_evidence_of_dense_points(spark):
    df = rows_of(spark, 25)
    rows = df.collect()
    f = field.Field(np.array([(r["x"], r["y"], r["t"]) for r in rows]), jitter=1e-9)
    a, s2 = np.array([r["slope"] for r in rows]), np.array([r["noise"] ** 2 for r in rows])
    r = np.array([q["value"] - q["intercept"] - q["slope"] * q["prior"] for q in rows])
    k = f.gram() * np.outer(a, a) + np.diag(s2)
    want = -0.5 * (r @ np.linalg.solve(k, r) + np.linalg.slogdet(k)[1] + len(r) * np.log(2 * np.pi))
    assert field.evidence(field.information_sums(df, f)[""], f) == pytest.approx(want, abs=1e-3)


def test_sequential_filter_against_gain_form(spark):
    df = rows_of(spark, 24)
    f = field.Field(field.regular_points(3, 1), jitter=1e-8)
    s = field.sequential_filter(df, f, [0, 1, 2, 3, 6])
    z = s.field.points
    k = s.field.gram() + 1e-8 * np.eye(len(z))
    mean, cov, last = np.zeros(len(z)), k.copy(), None
    for i, d in enumerate([0, 1, 2, 3, 6]):
        a = np.exp(-(d - last) / 5.0) if last is not None else 0.0
        mean, cov, last = a * mean, a * a * cov + (1 - a * a) * k, d
        own = [r for r in df.collect() if r["day"] == d]
        if own:
            x = np.array([(r["x"], r["y"], 0.0) for r in own])
            h = np.array([r["slope"] for r in own])[:, None] * s.field.cov(x, z) @ np.linalg.inv(k)
            res = np.array([r["value"] - r["intercept"] - r["slope"] * r["prior"] for r in own])
            gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + np.diag([r["noise"] ** 2 for r in own]))
            mean, cov = mean + gain @ (res - h @ mean), cov - gain @ h @ cov
        assert s.mean[i] == pytest.approx(mean, abs=1e-4)
    smooth = field.smooth_states(s)
    assert smooth.mean[-1] == pytest.approx(s.mean[-1]) and np.trace(smooth.cov[0]) <= np.trace(s.cov[0]) + 1e-9
    assert s.counts[-1] == 0


def test_predict_adds_prior_and_noise(spark):
    df = rows_of(spark)
    f = field.Field(field.regular_points(3, 2))
    p = field.fit(field.information_sums(df, f)[""], f)
    a = field.predict(df, p).agg(F.avg("std").alias("s")).first()["s"]
    b = field.predict(df, p, noise=1.0).agg(F.avg("std").alias("s")).first()["s"]
    assert b > a > 0


def test_samples_are_reproducible(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5)], "id int, mean double, std double")
    s = [field.samples(df.repartition(n), ["id"], 400).first()["samples"] for n in (1, 3)]
    assert s[0] == s[1] and abs(np.mean(s[0]) - 2.0) < 0.1 and abs(np.std(s[0]) - 0.5) < 0.08


def test_leave_key_out_equals_refit(spark):
    df = rows_of(spark)
    f = field.Field(field.regular_points(3, 2))
    got = {(r["x"], r["y"]): (r["mean"], r["std"]) for r in field.leave_key_out(df, field.information_sums(df, f)[""], f, "day").collect()}
    for d in range(4):
        rest = field.fit(field.information_sums(df.filter(F.col("day") != d), f)[""], f)
        for r in field.predict(df.filter(F.col("day") == d), rest).collect():
            assert got[(r["x"], r["y"])] == pytest.approx((r["mean"], r["std"]), abs=1e-6)


def test_left_out_keys_equal_a_new_fit(spark):
    """Low-rank downdates, and keys with more rows than inducing points, against sums without the key."""
    df = rows_of(spark, 60)
    rows = df.collect()
    at = lambda rs: np.array([(r["x"], r["y"], r["t"]) for r in rs])
    for f in (field.Field(field.regular_points(3, 2)), field.Field(field.regular_points(2, 1))):
        total, by_day = field.information_sums(df, f)[""], field.information_sums(df, f, key="day")
        got = field.leave_key_out(df, total, f, "day", noise=0.1).collect()
        for day in range(4):
            mean, var = field.fit(total - by_day[str(day)], f).at(at([r for r in got if r["day"] == day]))
            assert [r["mean"] - r["prior"] for r in got if r["day"] == day] == pytest.approx(mean, abs=1e-6)
            assert [r["std"] ** 2 - 0.01 for r in got if r["day"] == day] == pytest.approx(var, abs=1e-6)
    assert len(got) == len(rows)


def test_sums_of_many_fields_share_the_kernel(spark, monkeypatch):
    """Sums of fields of all kinds equal their definition, and fields with equal factors evaluate them once."""
    df = rows_of(spark, 60).withColumn("u", F.sin("x")).withColumn("w", F.cos("t")).repartition(1).sortWithinPartitions("x")
    rows = df.collect()
    p = np.random.default_rng(2).random((7, 5))
    f = field.Field(p, covariates=("u", "w"), lengths=(0.5, 2.0))
    fields = {"a": f, "b": field.replace(f, variance=2.5), "c": field.replace(f, time=1.7), "d": field.replace(f, lengths=(1.5, 0.3)), "e": field.replace(f, space=(0.2, 0.9)), "f": field.Field(p[:4, :3], variance=0.7, kernel="matern52")}
    want = {}
    for n, g in fields.items():
        k = g.cov(np.array([[r[c] for c in g.columns] for r in rows]), g.points)
        a, s2 = np.array([r["slope"] for r in rows]), np.array([r["noise"] ** 2 for r in rows])
        y = np.array([r["value"] - r["intercept"] - r["slope"] * r["prior"] for r in rows])
        want[n] = field.Sums(k.T @ (k * (a * a / s2)[:, None]), k.T @ (a * y / s2), len(rows), float((y * y / s2).sum()), float(np.log(s2).sum()), float((a * a / s2).sum() * g.variance))
    for key in (None, "source"):
        got = field.information_sums(df, fields, key=key)
        if key:
            got = {n: got[f"{n}|s"] + got[f"{n}|u"] for n in fields}
        for n in fields:
            for c in ("a", "b", "n", "square", "log_noise", "precision"):
                assert getattr(got[n], c) == pytest.approx(getattr(want[n], c), rel=1e-9, abs=1e-9)
    x, known = np.array([[r[c] for c in f.columns] for r in rows]), {}
    calls = []
    monkeypatch.setitem(field.CORRELATION, "rbf", lambda d: calls.append(d.shape) or np.exp(-0.5 * d * d))
    for g in (fields["a"], fields["b"], fields["c"], fields["e"]):
        g.correlations(x, known)
    assert len(calls) == 2  # one for each covariate, whatever the number of fields
    for g in (fields["a"], fields["d"], fields["e"]):
        assert g.correlations(x, known) == pytest.approx(g.cov(x, p), rel=1e-12)


def test_left_out_keys_meet_in_many_even_tasks(spark):
    """Keys of all sizes, one without a name, across Arrow batches: each equals a new fit, and few bytes are many tasks."""
    rng = np.random.default_rng(3)
    data = [(*map(float, rng.random(3)), float(rng.normal()), 0.1, "s", None if k == 9 else f"k{k}") for k in range(40) for _ in range(k % 11 + 1)]
    df = field.with_source(spark.createDataFrame(data, "x double, y double, t double, value double, prior double, source string, cell string"), [Source("s", "s", 0.4, 0.9)])
    f = field.Field(field.regular_points(2, 2))
    total = field.information_sums(df, f)[""]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = field.leave_key_out(df, total, f, "cell", noise=0.1)
        got = out.collect()
        assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["x"], r["value"]) for r in got) == sorted((r[0], r[3]) for r in data)
    for cell in {r["cell"] for r in got}:
        own = [r for r in got if r["cell"] == cell]
        kx = f.cov(np.array([(r["x"], r["y"], r["t"]) for r in own]), f.points)
        b = np.array([0.9 * (r["value"] - 0.9 * r["prior"]) / 0.16 for r in own])
        mean, var = field.fit(total - field.Sums(kx.T @ kx * (0.81 / 0.16), kx.T @ b), f).at(np.array([(r["x"], r["y"], r["t"]) for r in own]))
        assert [r["mean"] - 0.1 for r in own] == pytest.approx(mean, abs=1e-8)
        assert [r["std"] ** 2 - 0.01 for r in own] == pytest.approx(var, abs=1e-8)


def test_task_memory_does_not_change_sums(spark):
    df = rows_of(spark)
    f = field.Field(field.regular_points(2, 1))
    a, b = field.information_sums(df, f, key="day"), field.information_sums(df, f, key="day", most_keys=1)
    assert a.keys() == b.keys() and all(a[k].a == pytest.approx(b[k].a) and a[k].n == b[k].n for k in a)


def test_export_inverts_the_scaling(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.5, 0.5)], "mean double, std double")
    got = field.exported(df, 20.0, 10.0, (0.95, 0.5)).collect()
    assert [(r["mean"], r["std"]) for r in got] == [(20.0, 10.0), (35.0, 5.0)]
    assert all(r["upper_95"] - r["mean"] == pytest.approx(1.959963984540054 * r["std"]) and r["lower_95"] < r["lower_50"] < r["mean"] < r["upper_50"] for r in got)


def test_day_states_properties(spark):
    """Variances shrink with data, days without data only propagate, both states come from one pass."""
    df = rows_of(spark, 48)
    f = field.Field(field.regular_points(3, 1), jitter=1e-8)
    states = field.sequential_filter(df, f, [0, 1, 2, 3, 20])
    smooth = field.smooth_states(states)
    grid = spark.createDataFrame([(0.2, 0.3, 1.0, d) for d in (0, 1, 2, 3, 20)], "x double, y double, prior double, day int")
    got = {r["day"]: r for r in field.predict_states(grid, states, smoothed=smooth).collect()}
    apart = {r["day"]: r for r in field.predict_states(grid, smooth).collect()}
    assert all(got[d]["smooth_mean"] == pytest.approx(apart[d]["mean"]) and got[d]["smooth_std"] == pytest.approx(apart[d]["std"]) for d in got)
    assert got[20]["n_obs"] == 0 and abs(got[20]["mean"] - 1.0) < abs(got[3]["mean"] - 1.0) and got[20]["std"] > got[3]["std"]
    assert all(got[d]["smooth_std"] <= got[d]["std"] + 1e-9 for d in got) and got[20]["smooth_mean"] == pytest.approx(got[20]["mean"])
    assert (np.diagonal(states.cov[:4], axis1=1, axis2=2) < np.diagonal(states.predicted_cov[:4], axis1=1, axis2=2)).all()


def test_point_pickers(spark):
    df = rows_of(spark, 30)
    have = {(r["x"], r["y"], r["t"]) for r in df.collect()}
    picked = field.hashed_points(df, 7)
    assert len(picked) == 7 and {tuple(p) for p in picked} <= have and (picked == field.hashed_points(df.repartition(5), 7)).all()
    centres = field.kmeans_points(df, 4)
    assert centres.shape == (4, 3) and (centres >= 0).all() and (centres <= 1).all()


def dense_kriging(rows, grid, f, noise):
    """Regression and the dense process of its residuals."""
    x, y, base, v = np.array(rows).T
    slope, shift = np.polyfit(base, v, 1)
    at = lambda a, b: np.column_stack([a, b, np.zeros(len(a))])
    k = f.cov(at(x, y), at(x, y)) + noise**2 * np.eye(len(x))
    w = np.linalg.solve(k, v - slope * base - shift)
    gx, gy, gb = np.array(grid).T
    return slope * gb + shift + f.cov(at(gx, gy), at(x, y)) @ w


@pytest.mark.parametrize("n,block,low", [(5, 2000, 500), (500, 150, 200), (6000, 2000, 500)])
def test_kriging_equals_the_dense_process(spark, monkeypatch, n, block, low):
    monkeypatch.setattr(field, "BLOCK_POINTS", block)
    monkeypatch.setattr(field, "PRECONDITIONER", low)
    rng = np.random.default_rng(7)
    place = rng.random((n, 2))
    rows = [(float(a), float(b), float(np.sin(5 * a) + b), float(2 + 3 * np.sin(5 * a) + np.cos(9 * b * a) + 0.1 * rng.normal())) for a, b in place]
    grid = [(i / 19, j / 19, np.sin(5 * i / 19)) for i in range(20) for j in range(20)] + [(0.5, 0.5, 0.1)] * 2
    f = field.Field(field.regular_points(2, 1), space=0.2)
    df = spark.createDataFrame(rows, "x double, y double, baseline double, value double")
    out = field.regression_kriging(df, spark.createDataFrame([(i, *map(float, g)) for i, g in enumerate(grid)], "k int, x double, y double, baseline double"), f, noise=0.3)
    got = {r["k"]: r["mean"] for r in out.collect()}
    assert [got[i] for i in range(len(grid))] == pytest.approx(list(dense_kriging(rows, grid, f, 0.3)), abs=1e-6)


def test_kriging_of_few_stations_is_the_regression(spark):
    df = spark.createDataFrame([(0.1 * i, 0.2, float(i), 2.0 * i + 1) for i in range(4)], "x double, y double, baseline double, value double")
    grid = spark.createDataFrame([(0.0, 0.0, 10.0)], "x double, y double, baseline double")
    f = field.Field(field.regular_points(2, 1))
    assert [r["mean"] for r in field.regression_kriging(df, grid, f).collect()] == pytest.approx([21.0])
    assert [r["mean"] for r in field.regression_kriging(df.limit(0), grid, f).collect()] == [10.0]
    assert field.solve_process(df.select("x", "y", "baseline", "value").withColumnRenamed("baseline", "t").limit(0), f, 1.0)[0].collect() == []


def planted(n=900, seed=11):
    """Rows whose values depend on place and on the covariate u, not on v; stations are few places."""
    rng = np.random.default_rng(seed)
    spots = rng.random((30, 2))
    rows = []
    for i in range(n):
        a, b = spots[i % 30]
        u, v, t = rng.normal(), rng.normal(), (i // 30) / 30
        rows.append((f"s{i % 30}", float(a), float(b), float(t), float(u), float(v), float(np.sin(4 * a) + np.sin(1.5 * u) + 0.1 * rng.normal())))
    return rows


def covariate_frame(spark, rows):
    df = spark.createDataFrame(rows, "grid_id string, x double, y double, t double, u double, v double, value double")
    return df.withColumns({"prior": F.lit(0.0), "slope": F.lit(1.0), "intercept": F.lit(0.0), "noise": F.lit(0.2)})


def test_covariate_field_equals_the_dense_process(spark):
    rows = planted(120)
    x = np.array([r[1:6] for r in rows])
    y = np.array([r[6] for r in rows])
    f = field.Field(x, space=(0.4, 0.9), time=2.0, covariates=("u", "v"), lengths=(0.8, 5.0), jitter=1e-9)
    df = covariate_frame(spark, rows)
    post = field.fit(field.information_sums(df, f)[""], f)
    new = planted(20, 5)
    got = {r["u"]: (r["mean"], r["std"]) for r in field.predict(covariate_frame(spark, new), post).collect()}

    def kernel(a, b):  # written out pair by pair
        out = np.empty((len(a), len(b)))
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                d = np.sqrt(3) * np.sqrt(((p[0] - q[0]) / 0.4) ** 2 + ((p[1] - q[1]) / 0.9) ** 2)
                out[i, j] = (1 + d) * np.exp(-d) * np.exp(-abs(p[2] - q[2]) / 2.0) * np.exp(-0.5 * ((p[3] - q[3]) / 0.8) ** 2 - 0.5 * ((p[4] - q[4]) / 5.0) ** 2)
        return out

    k = kernel(x, x) + 0.04 * np.eye(len(x))
    kx = kernel(np.array([r[1:6] for r in new]), x)
    mean, var = kx @ np.linalg.solve(k, y), 1 - np.einsum("ij,ji->i", kx, np.linalg.solve(k, kx.T))
    for r, m, s2 in zip(new, mean, var):
        assert got[r[4]] == (pytest.approx(m, abs=1e-4), pytest.approx(np.sqrt(s2), abs=1e-4))


def test_covariate_lowers_the_held_out_error(spark):
    df = covariate_frame(spark, planted())
    u = field.Field(field.kmeans_points(df, 80, columns=("x", "y", "t", "u"), lengths=(0.3, 0.3, 1.0, 0.5)), time=1.0, covariates=("u",), lengths=(1.0,))
    none = field.Field(field.kmeans_points(df, 80, lengths=(0.3, 0.3, 1.0)), time=1.0)
    error = {}
    for name, f in (("u", u), ("none", none)):
        out = field.leave_key_out(df, field.information_sums(df, f)[""], f, "grid_id")
        error[name] = out.agg(F.sqrt(F.avg((F.col("mean") - F.col("value")) ** 2))).first()[0]
    assert error["u"] < 0.6 * error["none"], error


def test_relevance_search_finds_the_covariate_that_matters(spark):
    df = covariate_frame(spark, planted(600))
    start = field.Field(field.kmeans_points(df, 60, columns=("x", "y", "t", "u", "v"), lengths=(0.3, 0.3, 1.0, 1.0, 1.0)), time=1.0, covariates=("u", "v"), lengths=(1.0, 1.0))
    tuned, history = field.tuned_field(df, start, rounds=4)
    evidence = [h["evidence"] for h in history]
    assert evidence == sorted(evidence) and evidence[0] >= field.evidence(field.information_sums(df, start)[""], start)
    lengths = dict(zip(tuned.covariates, tuned.lengths))
    assert lengths["v"] > 2 * lengths["u"] and tuned.columns == ["x", "y", "t", "u", "v"]
    assert tuned.scales() == {k: v for k, v in history[-1].items() if k != "evidence"}


def test_source_parameters_are_learned(spark):
    """Planted slope, intercept and noises come back, evidence never falls, and sums under any values equal those of the rows."""
    rng = np.random.default_rng(12)
    spots = rng.random((1200, 3)) * [1, 1, 0.2]
    truth = np.sin(5 * spots[:, 0]) + np.cos(4 * spots[:, 1])
    rows = []
    for i, ((x, y, t), z) in enumerate(zip(spots, truth)):
        source = "station" if i % 3 == 0 else "satellite"
        value = z + 0.15 * rng.normal() if source == "station" else 0.6 * z + 0.4 + 0.3 * rng.normal()
        rows.append((float(x), float(y), float(t), float(value), float(0.2 * z), source))
    df = spark.createDataFrame(rows, "x double, y double, t double, value double, prior double, source string")
    f = field.Field(field.kmeans_points(df, 60), space=0.5, time=2.0, kernel="rbf", time_kernel="rbf")  # smooth: the points hold nearly all of it
    start = [Source("station", "station", 1.0), Source("satellite", "satellite", 1.0), Source("absent", "absent", 0.5)]
    plain = field.information_sums(field.with_source(df, start), f)[""]
    own = field.sums_of(field.source_sums(df, f), start, f)
    assert own.a == pytest.approx(plain.a) and own.b == pytest.approx(plain.b)
    assert (own.n, own.square, own.log_noise, own.precision) == (plain.n, pytest.approx(plain.square), pytest.approx(plain.log_noise), pytest.approx(plain.precision))
    found, history = field.learned_sources(df, f, start, "station", rounds=60)
    by = {s.name: s for s in found}
    assert (by["station"].slope, by["station"].intercept) == (1.0, 0.0) and by["station"].noise == pytest.approx(0.15, abs=0.03)
    assert by["satellite"].slope == pytest.approx(0.6, abs=0.05) and by["satellite"].intercept == pytest.approx(0.4, abs=0.05) and by["satellite"].noise == pytest.approx(0.3, abs=0.03)
    assert by["absent"] == start[2]
    scores = [h["evidence"] for h in history if h["source"] == "station"]
    assert len(scores) == 61 and all(b >= a - 1e-6 * abs(a) for a, b in zip(scores, scores[1:]))


def test_joint_draws_spread_as_the_dense_covariance(spark):
    """Mean over a day's places and its spread, from draws, against the dense process."""
    df = rows_of(spark, 40)
    rows = df.collect()
    f = field.Field(np.array([(r["x"], r["y"], r["t"]) for r in rows]), space=0.6, time=1.0, jitter=1e-9)
    post = field.fit(field.information_sums(df, f)[""], f)
    out = field.joint_samples(df, post, 3000)
    got = {r["day"]: r for r in field.mean_of_draws(out, ["day"]).collect()}
    x = np.array([(r["x"], r["y"], r["t"]) for r in rows])
    a, s2 = np.array([r["slope"] for r in rows]), np.array([r["noise"] ** 2 for r in rows])
    k = f.cov(x, x)
    kx = k * a
    cov = k - kx @ np.linalg.solve(k * np.outer(a, a) + np.diag(s2), kx.T)
    mean = dense(rows, f, x)[0] + np.array([r["prior"] for r in rows])
    for day in range(4):
        own = np.array([r["day"] == day for r in rows])
        spread = np.sqrt(cov[np.ix_(own, own)].mean())
        assert got[day]["n"] == own.sum() and got[day]["mean"] == pytest.approx(mean[own].mean(), abs=0.05)
        assert got[day]["std"] == pytest.approx(spread, rel=0.08)
    again = field.joint_samples(df.repartition(7), post, 5).collect()
    assert {r["x"]: r["samples"] for r in again} == {r["x"]: pytest.approx(r["samples"][:5]) for r in field.joint_samples(df, post, 5).collect()}


def test_days_added_one_by_one_equal_all_at_once(spark, tmp_path):
    df = rows_of(spark, 60).withColumn("day", (F.col("x") * 12).cast("int"))
    f = field.Field(field.regular_points(3, 1), space=0.5)
    days = sorted(r[0] for r in df.select("day").distinct().collect())
    whole = field.sequential_filter(df, f, days)
    path = str(tmp_path / "kept")
    order = days[::2] + days[1::2]  # each later day lies between known ones
    for d in order[:-1]:
        field.add_days(df.filter(F.col("day") == d), path, f)
    half = df.withColumn("_k", F.row_number().over(Window.partitionBy("day").orderBy("x")))
    last = half.filter(F.col("day") == order[-1]).drop("_k")
    field.add_days(last.limit(0), path, f)  # nothing new
    field.add_days(half.filter((F.col("day") == order[-1]) & (F.col("_k") == 1)).drop("_k"), path, f)
    got = field.add_days(half.filter((F.col("day") == order[-1]) & (F.col("_k") > 1)).drop("_k"), path, f)  # further rows of a known day
    assert got.days == whole.days and got.counts == whole.counts and got.log_likelihood == pytest.approx(whole.log_likelihood)
    for c in ("mean", "cov", "predicted_mean", "predicted_cov", "factors"):
        assert getattr(got, c) == pytest.approx(getattr(whole, c), abs=1e-9), c
    versions = spark.read.parquet(path).groupBy("version").count().collect()
    assert len(versions) == len(days) + 1 - (half.filter((F.col("day") == order[-1])).count() == 1)


def test_samples_equal_the_column_form_and_run_in_batches(spark):
    from geoblend.functions.numerics import hash_unit

    rows = [(f"k{i}", i % 3 or None, float(i), 0.5 + i) for i in range(300)] + [(None, 1, 2.0, 1.0), ("\u00e9|", 2, None, 1.0), ("z", 2, 1.0, None)]
    df = spark.createDataFrame(rows, "id string, g int, mean double, std double").repartition(3)
    u = lambda i, tag: hash_unit(7, "id", "g", F.concat(F.lit(tag), i.cast("string"))) + F.lit(2.0**-33)
    plain = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("mean") + F.col("std") * F.sqrt(-2 * F.log(u(i, "a"))) * F.cos(2 * np.pi * u(i, "b")))
    drawn = field.samples(df, ["id", "g"], 5, 7)
    assert drawn.columns == [*df.columns, "samples"] and "MapInArrow" in drawn._jdf.queryExecution().toString()
    got = {(r["id"], r["g"]): list(r["samples"]) for r in drawn.collect()}
    want = {(r["id"], r["g"]): list(r["w"]) for r in df.withColumn("w", plain).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert all((x is None and y is None) or x == pytest.approx(y, abs=1e-9) for x, y in zip(got[k], v)) and len(got[k]) == 5, k


def test_block_pairs_are_dealt_evenly_whatever_the_source_blocks(spark, monkeypatch):
    """One source block against many target blocks is many tasks, with the same product."""
    monkeypatch.setattr(field, "TASK_PAIRS", 4)
    rng = np.random.default_rng(3)
    at, v, f = rng.random((30, 3)), rng.normal(size=30), field.Field(field.regular_points(2, 1), space=0.2)
    places = [rng.random((5, 3)) for _ in range(40)]
    pack = lambda x: bytearray(np.ascontiguousarray(x.T).tobytes())
    targets = spark.createDataFrame([(i, pack(x)) for i, x in enumerate(places)], "block int, at binary")
    sources = spark.createDataFrame([(0, pack(at), bytearray(v.tobytes()))], "block int, at binary, v binary")
    seen, plain = {}, field._sum_blocks
    monkeypatch.setattr(field, "_sum_blocks", lambda partial, name: seen.update(sizes=partial.rdd.glom().map(len).collect()) or plain(partial, name))
    got = {r["block"]: np.frombuffer(r["q"]) for r in field.kernel_product(targets, sources, 1, f).collect()}
    assert len(seen["sizes"]) == 10 and max(seen["sizes"]) <= 16
    assert all(got[i] == pytest.approx(f.cov(x, at) @ v) for i, x in enumerate(places))
    flat, other = np.column_stack([rng.random((9, 2)), np.zeros(9)]), np.column_stack([rng.random((7, 2)), np.zeros(7)])
    d = np.hypot(*(flat[:, None, :2] - other[None, :, :2]).transpose(2, 0, 1)) / 0.2
    assert f.cov(flat, other) == pytest.approx((1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d))


def test_large_batches_meet_the_points_in_steps(monkeypatch):
    f = field.Field(field.regular_points(3, 2))
    post = field.Posterior(f, np.arange(18.0), 0.01 * np.eye(18))
    x, sizes, plain = np.random.default_rng(1).random((2500, 3)), [], field.Field.cov
    want = post.field.cov(x, f.points) @ post.alpha
    monkeypatch.setattr(field.Field, "cov", lambda self, a, b: sizes.append(len(a)) or plain(self, a, b))
    mean, var = post.at(x)
    assert mean == pytest.approx(want) and len(var) == 2500 and max(sizes) <= 1000


@pytest.mark.parametrize("kernel,last", [("matern32", 0.0), ("matern52", 1.0), ("rbf", 0.0)])
def test_product_in_steps_equals_the_whole_kernel(monkeypatch, kernel, last):
    monkeypatch.setattr(field, "PRODUCT_PAIRS", 100)
    rng = np.random.default_rng(2)
    f = field.Field(field.regular_points(2, 1), space=(0.2, 0.5), time=0.4, variance=1.7, kernel=kernel)
    a, b, v = rng.random((33, 3)) * [1, 1, last], rng.random((21, 3)) * [1, 1, last], rng.normal(size=21)
    assert f.product(a, b, v) == pytest.approx(f.cov(a, b) @ v, abs=1e-12)
    assert list(f.product(a[:2], b[:0], v[:0])) == [0.0, 0.0] and len(f.product(a[:0], b, v)) == 0
