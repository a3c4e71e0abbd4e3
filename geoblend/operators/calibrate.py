"""Calibration between sources, regressions by normal equations, thinning and sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import global_rank, hash_unit
from .daily import nearest_days
from .spatial import nearest_join

#: With fewer colocated points than this the calibration is the identity.
LEAST_POINTS = 10


def linear_calibration(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n, slope, intercept, r2, mean_x, mean_y of y on x over rows with both; identity under LEAST_POINTS."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
    )
    few = (F.col("n") < LEAST_POINTS) | F.col("slope").isNull()
    return s.withColumn("slope", F.when(few, 1.0).otherwise(F.col("slope"))).withColumn("intercept", F.when(few, 0.0).otherwise(F.col("intercept"))).withColumn("r2", F.when(~few, F.col("r2")))


def apply_calibration(df: DataFrame, parameters: DataFrame, x: str, name: str) -> DataFrame:
    """Adds slope * x + intercept from a one-row parameter table."""
    p = parameters.select(F.col("slope").alias("_a"), F.col("intercept").alias("_b"))
    return df.crossJoin(F.broadcast(p)).withColumn(name, F.col("_a") * F.col(x) + F.col("_b")).drop("_a", "_b")


def normal_equations(df: DataFrame, features: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y (with a leading intercept) and the row count, by one aggregation."""
    x = [F.lit(1.0), *features]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i + 1)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(k)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    a, b = np.zeros((k, k)), np.array([r[f"b{i}"] or 0.0 for i in range(k)])
    for i in range(k):
        for j in range(i + 1):
            a[i, j] = a[j, i] = r[f"a{i}_{j}"] or 0.0
    return a, b, r["n"]


def fit_linear(df: DataFrame, features: list[str], y: str, ridge: float = 0.0) -> np.ndarray:
    """Coefficients (intercept first) of y on features; null features count as their mean. The ridge penalty covers the intercept too."""
    rows = df.filter(F.col(y).isNotNull())
    means = rows.agg(*[F.avg(f).alias(f) for f in features]).first()
    filled = [F.coalesce(F.col(f), F.lit(means[f] if means[f] is not None else 0.0)) for f in features]
    a, b, _ = normal_equations(rows, filled, F.col(y))
    a = a + ridge * np.eye(len(a))
    return np.linalg.lstsq(a, b, rcond=None)[0]


def standardized_ridge(df: DataFrame, grid: DataFrame, features: list[str], residual: str, penalty: float = 1.0) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Ridge of residuals on covariates standardised by the whole grid's statistics: (coefficients, {feature: (mean, std)})."""
    s = grid.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    scale = {f: (s[f"m_{f}"] or 0.0, s[f"s_{f}"] or 1.0) for f in features}
    z = [F.coalesce((F.col(f) - scale[f][0]) / scale[f][1], F.lit(0.0)) for f in features]
    a, b, _ = normal_equations(df.filter(F.col(residual).isNotNull()), z, F.col(residual))
    return np.linalg.solve(a + penalty * np.eye(len(a)), b), scale


def apply_ridge(coefficients: np.ndarray, scale: dict[str, tuple[float, float]], clip: float = 5.0) -> Column:
    """The ridge's value at a row's covariates, standardised and clipped to +- clip."""
    out = F.lit(float(coefficients[0]))
    for w, (f, (mean, std)) in zip(coefficients[1:], scale.items()):
        z = F.coalesce((F.col(f) - mean) / std, F.lit(0.0))
        out = out + float(w) * F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))
    return out


def pattern_prior(df: DataFrame, prior: str, pattern: str, day: str = "date", days: int = 10) -> DataFrame:
    """grid_id, corrected prior: cell means over the first `days` days, prior ~ pattern, its misfit added where known."""
    first = df.select(day).distinct().orderBy(day).limit(days)
    means = df.join(F.broadcast(first), day, "left_semi").groupBy("grid_id").agg(F.avg(prior).alias("p"), F.avg(pattern).alias("s"))
    fit = means.filter("p is not null and s is not null").agg(F.regr_slope("p", "s").alias("a"), F.regr_intercept("p", "s").alias("b"))
    out = means.crossJoin(F.broadcast(fit))
    shift = F.coalesce(F.col("a") * F.col("s") + F.col("b") - F.col("p"), F.lit(0.0))
    return out.select("grid_id", (F.col("p") + shift).alias("prior_corrected"), shift.alias("shift"))


def shifted(df: DataFrame, bias: str, columns: tuple[str, ...] = ("mean", "lower_95", "upper_95")) -> DataFrame:
    """Predictions and their bounds moved by the bias column (none: 0); widths stay."""
    return df.withColumns({c: F.col(c) + F.coalesce(F.col(bias), F.lit(0.0)) for c in columns})


def scaled_prior(df: DataFrame, y: str, prior: str, name: str = "prior_scaled") -> DataFrame:
    """The prior times the slope plus the intercept of y on it; without a fit the prior itself."""
    fit = df.filter(F.col(y).isNotNull() & F.col(prior).isNotNull()).agg(F.regr_slope(y, prior).alias("_a"), F.regr_intercept(y, prior).alias("_b"))
    return df.crossJoin(F.broadcast(fit)).withColumn(name, F.coalesce(F.col("_a") * F.col(prior) + F.col("_b"), F.col(prior))).drop("_a", "_b")


def correction_at(places: DataFrame, days: DataFrame, coefficients: np.ndarray, scale: dict[str, tuple[float, float]], key: str, size: tuple[float, float], day: str = "date") -> DataFrame:
    """Adds near_id, nearest_day, correction to places(key, latitude, longitude, day): the ridge's value on the covariates of
    the nearest cell on the nearest day of days(grid_id, latitude, longitude, day, covariates); without covariates there, 0."""
    cells = days.select("grid_id", "latitude", "longitude").distinct()
    where = places.select(key, "latitude", "longitude").distinct()
    near = nearest_join(where, cells, size, []).select(key, "near_id")
    when = nearest_days(places, days, day)
    asked = places.join(near, key, "left").join(when, day, "left")
    known = days.select(F.col("grid_id").alias("near_id"), F.col(day).alias("nearest_day"), apply_ridge(coefficients, scale).alias("correction"))
    out = asked.join(known, ["near_id", "nearest_day"], "left")
    return out.select(*places.columns, "near_id", "nearest_day", F.coalesce("correction", F.lit(0.0)).alias("correction"))


def residual_bias(df: DataFrame, y: str = "y", mean: str = "mean", by: list[str] | None = None) -> DataFrame:
    """Mean residual, global or by anchor."""
    return df.filter(F.col(y).isNotNull()).groupBy(*(by or [])).agg(F.avg(F.col(y) - F.col(mean)).alias("bias"), F.count(F.lit(1)).alias("n"))


def thin_repeats(df: DataFrame, value: str, day: str = "date", keep: int = 1, digits: int = 3, order: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """At most `keep` rows per day and rounded value, first by order. For one, an aggregate replaces the window, so a hot value is no task's burden."""
    marked = df.withColumn("_v", F.bround(value, digits))
    if keep == 1:
        rest = [c for c in df.columns if c != day]
        picked = marked.groupBy(day, "_v").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        return picked.select(day, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
    # Two steps: within salted parts of a value, then among the few left.
    parts = marked.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    within = Window.partitionBy(day, "_v", "_salt").orderBy(*order)
    over = Window.partitionBy(day, "_v").orderBy(*order)
    few = parts.withColumn("_k", F.row_number().over(within)).filter(F.col("_k") <= keep)
    return few.withColumn("_k", F.row_number().over(over)).filter(F.col("_k") <= keep).select(*df.columns)


def thinning_report(before: DataFrame, after: DataFrame, value: str, day: str = "date", digits: int = 3) -> DataFrame:
    groups = before.select(day, F.bround(value, digits).alias("_v")).distinct().agg(F.count(F.lit(1)).alias("n_groups"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(before, "n_before").crossJoin(n(after, "n_after")).crossJoin(groups)


def location_anomaly(df: DataFrame, value: str, name: str = "anomaly") -> DataFrame:
    """Per cell, log1p of the value standardised within the cell (sample std; no spread or one row gives 0)."""
    v = F.log1p(F.col(value))
    cells = df.groupBy("grid_id").agg(F.avg(v).alias("_m"), F.coalesce(F.nullif(F.stddev_samp(v), F.lit(0.0)), F.lit(1.0)).alias("_s"))
    return df.join(cells, "grid_id", "left").withColumn(name, (v - F.col("_m")) / F.col("_s")).select(*[c for c in df.columns if c != name], name)


def exact_sample(df: DataFrame, keys: list[str], seed: int, fraction: float | None = None, most: int | None = None) -> DataFrame:
    """max(1, int(n * fraction)) or at most `most` rows, those first in hash order: same size everywhere, same rows on any cluster."""
    n = df.count()
    size = max(1, int(n * fraction)) if fraction is not None else min(n, most or n)
    return global_rank(df.withColumn("_h", hash_unit(seed, *keys)), ["_h", *keys], "_rank").filter(F.col("_rank") <= size).drop("_h", "_rank")


def rate_sample(df: DataFrame, keys: list[str], seed: int, fraction: float) -> DataFrame:
    """Rows whose hash is below the fraction: approximate size, no sort."""
    return df.filter(hash_unit(seed, *keys) < fraction)
