"""Queries of scores, comparisons and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calibrate, metrics, report
from ..sources import roles as R
from ..sources.tables import Source
from .registry import query, roles, rounded

# The SQL is written out by itself: quantiles as numbers, the normal distribution by its series instead of rational approximations.
Z = {0.5: 0.6744897501960817, 0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054}
POINT = """count(*) AS n, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg((p - y) ** 2), 6) AS mse, round(avg(abs(p - y)), 6) AS mae, round(avg(p - y), 6) AS bias,
    round(100e0 * avg(CASE WHEN y <> 0 THEN abs((p - y) / y) END), 6) AS mape, round(CASE WHEN var_pop(y) > 0 THEN 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) WHEN sum((p - y) ** 2) = 0 THEN 1 ELSE 0 END, 6) AS r2, round(corr(y, p), 6) AS corr"""


def _series(k: int = 120) -> str:
    """0.5 + density * z * (1 + z^2/3 (1 + z^2/5 (1 + ...))) of a column z, up to the k-th factor."""
    text = "1e0"
    for i in range(k, 0, -1):
        text = f"(1e0 + z * z / {2 * i + 1}e0 * {text})"
    return f"(0.5e0 + exp(-0.5e0 * z * z) / sqrt(2e0 * pi()) * z * {text})"


PIT = f"z AS (SELECT *, mean AS p, (y - mean) / std AS z FROM predictions), pit AS (SELECT *, {_series()} AS f FROM z)"
CRPS = "std * (z * (2e0 * f - 1e0) + 2e0 * exp(-0.5e0 * z * z) / sqrt(2e0 * pi()) - 1e0 / sqrt(pi()))"
_COVER = {x: f"avg((abs(y - p) <= {z!r}e0 * std)::INT)" for x, z in Z.items()}
PROB = ", ".join([
    "round(avg(0.5e0 * ln(2e0 * pi()) + ln(std) + 0.5e0 * z * z), 6) AS nll", f"round(avg({CRPS}), 6) AS crps", "round(avg(z * z + 2e0 * ln(std)), 6) AS dss",
    "round(avg(2e0 * 1.6448536269514722e0 * std + CASE WHEN y < p - 1.6448536269514722e0 * std THEN 20e0 * (p - 1.6448536269514722e0 * std - y) WHEN y > p + 1.6448536269514722e0 * std THEN 20e0 * (y - p - 1.6448536269514722e0 * std) ELSE 0e0 END), 6) AS interval_score",
    "round(avg(std), 6) AS sharpness",
    *[f"round({c}, 6) AS coverage_{x * 100:g}" for x, c in _COVER.items()], "round((" + " + ".join(f"abs({c} - {x}e0)" for x, c in _COVER.items()) + f") / {len(_COVER)}e0, 6) AS calibration_error",
])
MODEL_ROWS = "m AS (SELECT station, source, day, y, std, mean AS p, 'fused' AS model FROM predictions UNION ALL SELECT station, source, day, y, std, baseline, 'baseline' FROM predictions)"


@query(roles("predictions") + f", {PIT} SELECT source, {POINT}, {PROB} FROM pit GROUP BY source")
def metrics_by_source(spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.evaluate(R.predictions(spark, sf_dir), by=["source"]))


@query(roles("predictions") + f", {PIT} SELECT {POINT}, {PROB} FROM pit")
def metrics_overall(spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.evaluate(R.predictions(spark, sf_dir)))


@query(roles("predictions") + f", {MODEL_ROWS} SELECT model, {POINT} FROM m GROUP BY model")
def model_comparison(spark, sf_dir: str) -> DataFrame:
    df = R.predictions(spark, sf_dir).withColumnRenamed("mean", "fused")
    return rounded(metrics.compare_models(df, ["fused", "baseline"]))


@query(roles("predictions") + f""", r AS (SELECT 'station_base' AS "case", y, baseline AS p, NULL::DOUBLE AS std FROM predictions UNION ALL SELECT 'station_fused', y, mean, std FROM predictions UNION ALL SELECT 'base_fused', baseline, mean, std FROM predictions),
    z AS (SELECT *, (y - p) / std AS z FROM r), f AS (SELECT *, {_series()} AS f FROM z)
    SELECT "case", {POINT}, round(avg({CRPS}), 6) AS crps, round({_COVER[0.9]}, 6) AS coverage_90 FROM f GROUP BY "case" """)
def three_cases(spark, sf_dir: str) -> DataFrame:
    cases = {"station_base": ("y", "baseline", None), "station_fused": ("y", "mean", "std"), "base_fused": ("baseline", "mean", "std")}
    out = metrics.compare_cases(R.predictions(spark, sf_dir), cases)
    return rounded(out.select("case", "n", "rmse", "mse", "mae", "bias", "mape", "r2", "corr", "crps", "coverage_90"))


@query(roles("predictions") + f""", {MODEL_ROWS}, s AS (SELECT model, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae, corr(y, p) AS corr FROM m GROUP BY model),
    l AS (SELECT 'rmse' AS metric, model, rmse AS v, 1 AS sg FROM s UNION ALL SELECT 'mae', model, mae, 1 FROM s UNION ALL SELECT 'corr', model, corr, -1 FROM s),
    w AS (SELECT metric, any_value(sg) AS sg, max(CASE WHEN model = 'baseline' THEN v END) AS base, max(CASE WHEN model = 'fused' THEN v END) AS fused FROM l GROUP BY metric)
    SELECT metric, round(base, 6) AS base, round(fused, 6) AS fused, round(100e0 * sg * (base - fused) / nullif(abs(base), 0), 4) AS improvement_pct FROM w""")
def improvement(spark, sf_dir: str) -> DataFrame:
    df = metrics.compare_models(R.predictions(spark, sf_dir).withColumnRenamed("mean", "fused"), ["fused", "baseline"])
    return rounded(metrics.improvement(df, "baseline", "fused", "model", ["rmse", "mae"], ["corr"]), improvement_pct=4)


@query(roles("predictions") + """, s AS (SELECT avg(y) AS a, avg(mean - y) AS b FROM predictions), r AS (SELECT 'model' AS "case", mean - y AS e FROM predictions UNION ALL SELECT 'mean_baseline', a - y FROM predictions, s UNION ALL SELECT 'bias_corrected', mean - y - b FROM predictions, s)
    SELECT "case", round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM r GROUP BY "case" """)
def against_mean(spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.against_mean(R.predictions(spark, sf_dir)))


@query(roles("predictions") + f""", {PIT}, r AS (SELECT f, row_number() OVER (ORDER BY f) AS i, count(*) OVER () AS n FROM pit)
    SELECT round(max(greatest(i / n::DOUBLE - f, f - (i - 1) / n::DOUBLE)), 6) AS ks FROM r""")
def pit_deviation(spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.ks_uniform(metrics.scored(R.predictions(spark, sf_dir))))


@query(roles("predictions") + f""", {PIT}, c AS (SELECT least(floor(f * 10)::INT, 9) AS bin, count(*) AS n FROM pit GROUP BY 1),
    g AS (SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(10) t(i) LEFT JOIN c ON c.bin = i), s AS (SELECT *, sum(n) OVER () AS tot FROM g)
    SELECT bin, n, round(n / tot::DOUBLE, 6) AS share, round(0.1e0 - 1.96e0 * sqrt(0.09e0 / tot), 6) AS band_low, round(0.1e0 + 1.96e0 * sqrt(0.09e0 / tot), 6) AS band_high FROM s""")
def pit_histogram(spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.histogram(metrics.scored(R.predictions(spark, sf_dir)), "pit"))


@query(roles("predictions") + """, e AS (SELECT (y - mean) / greatest(std, 1e-6) AS z FROM predictions), c AS (SELECT least(floor((z + 4) / 8 * 16)::INT, 15) AS bin, count(*) AS n FROM e WHERE z BETWEEN -4 AND 4 GROUP BY 1),
    g AS (SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(16) t(i) LEFT JOIN c ON c.bin = i) SELECT bin, n FROM g""")
def error_histogram(spark, sf_dir: str) -> DataFrame:
    df = R.predictions(spark, sf_dir).withColumn("z", scalars.standardized_residual(F.col("y"), F.col("mean"), F.col("std")))
    return metrics.histogram(df, "z", 16, -4.0, 4.0).select("bin", "n")


_QUANTILES = {
    0.1: 0.12566134685507402, 0.2: 0.2533471031357997, 0.3: 0.3853204664075676, 0.4: 0.5244005127080407, 0.5: 0.6744897501960817,
    0.6: 0.8416212335729143, 0.7: 1.0364333894937898, 0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054,
}


@query(roles("predictions") + " " + " UNION ALL ".join(f"SELECT {x}e0 AS level, round(avg((abs(y - mean) <= {z!r}e0 * std)::INT), 6) AS observed, count(*) AS n, round(sqrt({x}e0 * (1 - {x}e0) / count(*)), 6) AS se FROM predictions" for x, z in _QUANTILES.items()))
def reliability(spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability(R.predictions(spark, sf_dir)))


@query(roles("predictions") + """, q AS (SELECT quantile_cont(std, [0.2, 0.4, 0.6, 0.8]) AS q FROM predictions), b AS (SELECT len(list_filter(q, lambda x: x < std))::INT AS bin, std, abs(y - mean) AS e FROM predictions, q)
    SELECT bin, count(*) AS n, round(avg(std), 6) AS mean_std, round(avg(e), 6) AS mean_abs_error, round(stddev_samp(e) / sqrt(count(*)), 6) AS se FROM b GROUP BY bin""")
def error_by_uncertainty(spark, sf_dir: str) -> DataFrame:
    return rounded(metrics.error_by_uncertainty(R.predictions(spark, sf_dir)))


@query("""WITH e AS (SELECT vec_id, label::DOUBLE AS y, embedding, len(embedding) // 2 AS h FROM embeddings)
    SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: abs(x::DOUBLE - y))) - 0.5e0 * list_avg(list_transform(range(1, h + 1), lambda i: abs(embedding[i]::DOUBLE - embedding[i + h]::DOUBLE))), 6) AS score FROM e""")
def energy_score(spark, sf_dir: str) -> DataFrame:
    df = R.table(spark, sf_dir, "embeddings")
    return rounded(df.select("vec_id", metrics.energy_score("embedding", F.col("label").cast("double")).alias("score")))


def loso_table(spark, sf_dir: str) -> DataFrame:
    df = R.predictions(spark, sf_dir).withColumnRenamed("mean", "fused")
    return metrics.compare_models(df, ["fused", "baseline"], by=["station"])


_LOSO = f"{MODEL_ROWS}, t AS (SELECT station, model, count(*) AS n, sqrt(avg((p - y) ** 2)) AS rmse, avg((p - y) ** 2) AS mse, avg(abs(p - y)) AS mae, avg(p - y) AS bias FROM m GROUP BY station, model)"


@query(roles("predictions") + f", {_LOSO} SELECT model, count(*) AS n_stations, round(avg(rmse), 6) AS mean_rmse, round(median(rmse), 6) AS median_rmse, round(avg(mae), 6) AS mean_mae, round(median(mae), 6) AS median_mae, round(avg(abs(bias)), 6) AS mean_abs_bias FROM t GROUP BY model")
def loso_summary(spark, sf_dir: str) -> DataFrame:
    return rounded(report.loso_summary(loso_table(spark, sf_dir)))


@query(roles("predictions") + f", {_LOSO} SELECT station, round(max(CASE WHEN model = 'fused' THEN rmse END), 6) AS fused, round(max(CASE WHEN model = 'baseline' THEN rmse END), 6) AS baseline, round(max(CASE WHEN model = 'fused' THEN rmse END) - max(CASE WHEN model = 'baseline' THEN rmse END), 6) AS fused_minus_baseline, arg_min(model, rmse) AS winner FROM t GROUP BY station")
def loso_winner(spark, sf_dir: str) -> DataFrame:
    return rounded(report.loso_winner(loso_table(spark, sf_dir), ["fused", "baseline"], differences=[("fused", "baseline")]))


@query(roles("predictions") + f", {_LOSO} SELECT model, sum(n)::BIGINT AS n, round(sqrt(sum(mse * n) / sum(n)), 6) AS rmse, round(sum(mae * n) / sum(n), 6) AS mae, round(sum(bias * n) / sum(n), 6) AS bias FROM t GROUP BY model ORDER BY rmse")
def loso_pooled(spark, sf_dir: str) -> DataFrame:
    return rounded(report.pooled(loso_table(spark, sf_dir))).orderBy("rmse")


@query(roles("predictions") + """, s AS (SELECT source, sqrt(avg((mean - y) ** 2)) AS rmse, avg(abs(mean - y)) AS mae FROM predictions GROUP BY source), l AS (SELECT 'rmse' AS metric, rmse AS v FROM s UNION ALL SELECT 'mae', mae FROM s)
    SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY metric""")
def fold_summary(spark, sf_dir: str) -> DataFrame:
    folds = metrics.evaluate(R.predictions(spark, sf_dir), by=["source"])
    return rounded(report.fold_summary(folds, ["rmse", "mae"]))


@query(roles("predictions") + """, b AS (SELECT station, avg(y - mean) AS bias, count(*) AS n FROM predictions GROUP BY station), g AS (SELECT avg(y - mean) AS gb FROM predictions)
    SELECT p.station, count(*) AS n, round(any_value(bias), 6) AS bias, round(avg(mean + bias), 6) AS shifted, round(avg(mean + gb), 6) AS shifted_globally FROM predictions p JOIN b ON p.station = b.station, g GROUP BY p.station""")
def bias_anchors(spark, sf_dir: str) -> DataFrame:
    df = R.predictions(spark, sf_dir)
    anchors = calibrate.residual_bias(df, by=["station"]).select("station", "bias")
    overall = calibrate.residual_bias(df).select(F.col("bias").alias("gb"))
    rows = df.join(anchors, "station").crossJoin(F.broadcast(overall))
    return rounded(rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.first("bias").alias("bias"), F.avg(F.col("mean") + F.col("bias")).alias("shifted"), F.avg(F.col("mean") + F.col("gb")).alias("shifted_globally")))


@query(roles("predictions") + " SELECT day, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM predictions GROUP BY day", date="day")
def domain_average(spark, sf_dir: str) -> DataFrame:
    return rounded(report.domain_average(R.predictions(spark, sf_dir)))


@query(roles("predictions") + " SELECT day, count(*) AS n, round(avg(y), 6) AS observed, round(avg(mean), 6) AS predicted, (row_number() OVER (ORDER BY day))::INT AS ordinal FROM predictions GROUP BY day", date="day")
def daily_observed(spark, sf_dir: str) -> DataFrame:
    return rounded(report.daily_observed(R.predictions(spark, sf_dir)))


@query(roles("predictions") + """, s AS (SELECT station, avg(y) AS y, avg(mean) AS f, avg(baseline) AS b FROM predictions GROUP BY station), l AS (SELECT y, f AS p, 'fused' AS model FROM s UNION ALL SELECT y, b, 'baseline' FROM s)
    SELECT model, count(*) AS n, round(regr_slope(p, y), 6) AS slope, round(regr_intercept(p, y), 6) AS intercept, round(regr_r2(p, y), 6) AS r2, round(sqrt(avg((p - y) ** 2)), 6) AS rmse FROM l GROUP BY model""")
def station_fits(spark, sf_dir: str) -> DataFrame:
    return rounded(report.station_fits(R.predictions(spark, sf_dir).withColumnRenamed("mean", "fused"), ["fused", "baseline"]))


@query(roles("predictions") + " SELECT source, round(quantile_cont(y, 0.02), 6) AS low, round(quantile_cont(y, 0.98), 6) AS high FROM predictions GROUP BY source")
def clip_limits(spark, sf_dir: str) -> DataFrame:
    return rounded(report.clip_limits(R.predictions(spark, sf_dir), "y", ["source"]))


@query(roles("predictions") + ", r AS (SELECT *, row_number() OVER (ORDER BY y, id) AS rk FROM predictions) SELECT id, y, rk AS rank FROM r WHERE (rk - 1) % 50 = 0")
def ordered_thinning(spark, sf_dir: str) -> DataFrame:
    from ..functions.numerics import global_rank

    df = R.predictions(spark, sf_dir).select("id", "y")
    return report.every_nth(global_rank(df, ["y", "id"]), F.lit(50)).select("id", "y", "rank")


@query(roles("predictions") + """, b AS (SELECT l_suppkey % 7 + 1 AS m, sqrt(avg((25e0 + 100e0 * (l_discount - 0.05e0) - l_quantity) ** 2)) * 10 AS rmse, sum(l_quantity) AS seconds FROM lineitem GROUP BY 1),
    d AS (SELECT *, max(rmse) OVER () - min(rmse) OVER () < 0.5 AS flat, lead(seconds) OVER w - 2 * seconds + lag(seconds) OVER w AS c2, abs((rmse - lag(rmse) OVER w) / (m - lag(m) OVER w)) AS sl FROM b WINDOW w AS (ORDER BY m)),
    e AS (SELECT m, CASE WHEN flat THEN c2 ELSE sl END AS bend FROM d) SELECT m AS knee, round(bend, 4) AS bend FROM e WHERE bend IS NOT NULL ORDER BY bend DESC, m LIMIT 1""")
def sweep_knee(spark, sf_dir: str) -> DataFrame:
    li = R.table(spark, sf_dir, "lineitem")
    e = 25.0 + 100.0 * (F.col("l_discount") - 0.05) - F.col("l_quantity")
    sweep = li.groupBy((F.col("l_suppkey") % 7 + 1).alias("m")).agg((F.sqrt(F.avg(e * e)) * 10).alias("rmse"), F.sum("l_quantity").alias("seconds"))
    return rounded(report.knee(sweep), 4)


@query(roles("predictions") + """, x AS (SELECT id, mean, std, CASE WHEN abs(mean) > 1e-9 THEN least(greatest(std / abs(mean), 0e0), 2e0) END AS cv, greatest(mean - 15e0, 0e0) AS clipped, """
       "CASE WHEN y < 0 THEN -1 WHEN y < 5 THEN 0 WHEN y < 8 THEN 1 WHEN y < 10 THEN 2 WHEN y < 12 THEN 3 WHEN y < 15 THEN 4 WHEN y < 18 THEN 5 WHEN y < 22 THEN 6 WHEN y < 28 THEN 7 WHEN y < 40 THEN 8 ELSE 9 END AS cls FROM predictions)"
       + f" SELECT id, round(mean - {Z[0.95]!r}e0 * std, 6) AS lower_95, round(mean + {Z[0.95]!r}e0 * std, 6) AS upper_95, round(mean - {Z[0.5]!r}e0 * std, 6) AS lower_50, round(mean + {Z[0.5]!r}e0 * std, 6) AS upper_50, round(cv, 6) AS cv, round(clipped, 6) AS clipped, cls AS no2_class FROM x")
def intervals(spark, sf_dir: str) -> DataFrame:
    """Confidence bounds, coefficient of variation, clipped map value and fixed class of every prediction."""
    m, s = F.col("mean"), F.col("std")
    return rounded(R.predictions(spark, sf_dir).select("id", *scalars.interval(m, s, (0.95, 0.5)), scalars.variation(m, s).alias("cv"), F.greatest(m - 15.0, F.lit(0.0)).alias("clipped"), scalars.no2_class(F.col("y")).alias("no2_class")))


SOURCES = [Source("A", "y", 5.0, 1.0, 0.0), Source("N", "y", 8.0, 0.9, 1.0), Source("R", "y", 6.0, 1.1, -1.0)]


@query(roles("predictions") + """, s(source, noise, a, b) AS (VALUES ('A', 5e0, 1e0, 0e0), ('N', 8e0, 0.9e0, 1e0), ('R', 6e0, 1.1e0, -1e0)),
    r AS (SELECT source, y, a * mean + b AS m, a * a * std * std + noise * noise AS v, (y - b) / a AS u FROM predictions JOIN s USING (source))
    SELECT source, count(*) AS n, round(sum(-0.5e0 * ln(2 * pi() * v) - (y - m) ** 2 / (2 * v)), 4) AS log_density, round(avg(u), 6) AS mean_unlinked FROM r GROUP BY source""")
def source_log_density(spark, sf_dir: str) -> DataFrame:
    from ..operators.field import with_source

    df = with_source(R.predictions(spark, sf_dir), SOURCES)
    mean = scalars.link(F.col("mean"), F.col("slope"), F.col("intercept"))
    var = F.col("slope") ** 2 * F.col("std") ** 2 + F.col("noise") ** 2
    out = df.withColumn("ld", scalars.gaussian_log_density(F.col("y"), mean, var)).withColumn("u", scalars.unlink(F.col("y"), F.col("slope"), F.col("intercept")))
    return rounded(out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("ld").alias("log_density"), F.avg("u").alias("mean_unlinked")), log_density=4)
