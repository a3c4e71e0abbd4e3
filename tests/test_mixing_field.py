import numpy as np
import pytest

from geoblend.operators import field, mixing_field
from geoblend.sources.tables import Source

SCHEMA = "x double, y double, t double, value double, prior double, source string"


def planted(seed=3, sparse=30, dense=600, link=0.9):
    """Two sources whose fields are drawn with correlation `link` from one process of length scale 0.15; the first has few rows."""
    rng = np.random.default_rng(seed)
    n = sparse + dense
    at = rng.random((n, 3)) * [1, 1, 0.1]
    root = np.linalg.cholesky(smooth(space=0.15).cov(at, at) + 1e-6 * np.eye(n))
    one, two = (root @ rng.normal(size=n) for _ in range(2))
    rows = []
    for i, ((x, y, t), a, b) in enumerate(zip(at, one, two)):
        prior = rng.normal()
        value = prior + a + 0.1 * rng.normal() if i < sparse else 0.5 * prior + 0.7 * (link * a + np.sqrt(1 - link**2) * b) + 0.2 + 0.1 * rng.normal()
        rows.append((float(x), float(y), float(t), float(value), float(prior), "few" if i < sparse else "many"))
    return rows, at, one


def smooth(m=120, seed=1, space=0.3):
    rng = np.random.default_rng(seed)
    return field.Field(rng.random((m, 3)) * [1, 1, 0.1], space=space, time=2.0, kernel="rbf", time_kernel="rbf")


SOURCES = [Source("few", "few", 0.3), Source("many", "many", 0.3)]


def test_posterior_and_evidence_equal_the_dense_process(spark):
    rows, _, _ = planted(sparse=15, dense=20)
    df = spark.createDataFrame(rows, SCHEMA)
    points = np.array([r[:3] for r in rows])
    f = field.Field(points, space=0.4, time=0.5, jitter=1e-9)
    sources = (Source("few", "few", 0.3, 1.0, 0.0), Source("many", "many", 0.4, 0.5, 0.2))
    mixture = mixing_field.Mixture(f, sources, np.array([[0.9, 0.2], [0.6, -0.5]]))
    parts = field.source_sums(df, f)
    post = mixing_field.latent_posterior(parts, mixture)
    which = np.array([0 if r[5] == "few" else 1 for r in rows])
    b, s = mixture.weights @ mixture.weights.T, [sources[i] for i in which]
    residual = np.array([r[3] - o.intercept - o.slope * r[4] for r, o in zip(rows, s)])
    k = b[np.ix_(which, which)] * f.cov(points, points) + np.diag([o.noise**2 for o in s])
    at = np.random.default_rng(9).random((12, 3))
    for i, name in enumerate(("few", "many")):
        mean, var = post.of(name).at(at)
        kx = b[i, which] * f.cov(at, points)
        assert mean == pytest.approx(kx @ np.linalg.solve(k, residual), abs=1e-4)
        assert var == pytest.approx(b[i, i] * f.variance - np.einsum("ij,ji->i", kx, np.linalg.solve(k, kx.T)), abs=1e-4)
    want = -0.5 * (residual @ np.linalg.solve(k, residual) + np.linalg.slogdet(k)[1] + len(rows) * np.log(2 * np.pi))
    assert mixing_field.mixture_evidence(parts, mixture) == pytest.approx(want, abs=1e-3)


def test_one_latent_field_of_one_source_is_the_field_itself(spark):
    df = spark.createDataFrame([r for r in planted()[0] if r[5] == "few"], SCHEMA)
    f = smooth(20)
    mixture = mixing_field.Mixture(f, (Source("few", "few", 0.3),), np.ones((1, 1)))
    a = mixing_field.latent_posterior(field.source_sums(df, f), mixture).of("few")
    b = field.fit(field.information_sums(field.with_source(df, [Source("few", "few", 0.3)]), f)[""], f)
    at = np.random.default_rng(2).random((10, 3))
    for x, y in zip(a.at(at), b.at(at)):
        assert x == pytest.approx(y, abs=1e-6)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_sparse_source_gains_from_the_dense_one(spark, seed):
    """The sparse source's field at places where only the dense one has rows, farther from its own than the length scale:
    mixed against its own rows alone."""
    (rows, at, truth), f = planted(seed), smooth(space=0.15)
    df = spark.createDataFrame(rows, SCHEMA)
    parts = field.source_sums(df, f)
    tiles = df.selectExpr("cast(8 * x as int) as i", "cast(8 * y as int) as j", "source", "value", "prior")
    moments = [(r["source_a"], r["source_b"], r["covariance"]) for r in mixing_field.residual_moments(tiles, ["i", "j"], ["few", "many"]).collect()]
    mixture, history = mixing_field.learned_mixture(parts, mixing_field.start_mixture(f, SOURCES, moments), 60, keep=("few",))
    assert 2 < len(history) <= 61 and all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:]))
    alone, _ = mixing_field.learned_mixture({"few": parts["few"]}, mixing_field.Mixture(f, (SOURCES[0],), np.ones((1, 1))), 60, keep=("few",))
    many = {r[:3]: z for r, z in zip(rows, truth) if r[5] == "many"}
    probe = spark.createDataFrame([(*k, 0.0, float(z), "few") for k, z in many.items()], "x double, y double, t double, prior double, truth double, source string")
    error = {}
    for case, m, p in (("mixed", mixture, parts), ("alone", alone, {"few": parts["few"]})):
        got = mixing_field.predict_outputs(probe, {"few": (mixing_field.latent_posterior(p, m), "few")}, "source", noise=False).toPandas()
        error[case] = float(np.sqrt(np.mean((got["mean"] - got["truth"]) ** 2)))
    assert error["mixed"] < 0.8 * error["alone"], error
    many_source = mixture.sources[1]
    assert mixture.sources[0].slope == 1.0 and many_source.slope == pytest.approx(0.5, abs=0.1) and many_source.noise == pytest.approx(0.1, abs=0.05)
    c = mixture.covariance()
    assert c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]) > 0.6


def test_moments_by_pairs_of_sources(spark):
    rows = [(0.0, 0.0, float(t), v, 1.0, s) for s, values in (("few", (1.0, 3.0, 2.0)), ("many", (2.0, 4.0, 6.0, 9.0))) for t, v in enumerate(values)]
    rows += [(0.0, 0.0, 0.0, 5.0, 1.0, "many"), (0.0, 0.0, 0.0, None, 1.0, "few"), (0.0, 0.0, 9.0, 7.0, None, "few"), (0.0, 0.0, 9.0, 7.0, 1.0, "other")]
    got = {(r["source_a"], r["source_b"]): r for r in mixing_field.residual_moments(spark.createDataFrame(rows, SCHEMA), ["x", "y", "t"], ["few", "many"]).collect()}
    few, many = np.array([0.0, 2.0, 1.0]), np.array([2.5, 3.0, 5.0, 8.0])
    assert set(got) == {("few", "few"), ("few", "many"), ("many", "many")}
    assert got["few", "many"]["n"] == 3 and got["many", "many"]["n"] == 4
    assert got["few", "many"]["covariance"] == pytest.approx(np.cov(few, many[:3], bias=True)[0, 1])
    assert got["few", "many"]["correlation"] == pytest.approx(np.corrcoef(few, many[:3])[0, 1])
    assert got["many", "many"]["covariance"] == pytest.approx(np.var(many)) and got["few", "few"]["correlation"] == pytest.approx(1.0)
    empty = mixing_field.residual_moments(spark.createDataFrame([], SCHEMA), ["x"], ["few", "many"]).collect()
    assert [(r["n"], r["covariance"], r["correlation"]) for r in empty] == [(0, None, None)] * 3


def test_sums_taken_out_and_sources_without_rows(spark):
    rows, f = planted(sparse=20, dense=40)[0], smooth(15)
    df = spark.createDataFrame(rows, SCHEMA)
    parts = field.source_sums(df, f)
    taken = field.source_sums(df.filter("source = 'few' and x < 0.5"), f)
    rest = field.source_sums(df.filter("not (source = 'few' and x < 0.5)"), f)
    left = mixing_field.without(parts, taken)
    assert set(left) == set(rest) and all(a == pytest.approx(b) for s in rest for a, b in zip(left[s], rest[s]))
    assert set(mixing_field.without(parts, {"few": parts["few"]})) == {"many"}
    start = mixing_field.start_mixture(f, [*SOURCES, Source("absent", "absent", 0.5)], [])
    found, history = mixing_field.learned_mixture({"many": parts["many"]}, start, rounds=5)
    assert found.sources[0] == SOURCES[0] and found.sources[2].noise == 0.5 and np.isfinite(history).all()
    assert all(np.isfinite(x).all() for x in mixing_field.latent_posterior({}, start).of("absent").at(f.points))
    probe = spark.createDataFrame([(0.1, 0.2, 0.0, 0.3, "many", 1), (0.1, 0.2, 0.0, 0.3, "unknown", 2), (None, 0.2, 0.0, 0.3, "many", 3)], "x double, y double, t double, prior double, source string, _extra int")
    got = {r["_extra"]: r for r in mixing_field.predict_outputs(probe, {"many": (mixing_field.latent_posterior(parts, found), "many")}, "source").collect()}
    assert np.isfinite(got[1]["mean"]) and got[1]["std"] > 0
    assert all(got[i][c] is None for i in (2, 3) for c in ("mean", "std"))
