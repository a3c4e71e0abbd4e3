"""Point, probabilistic and calibration scores of predictions with uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import global_rank, norm_cdf_sql, norm_pdf_sql, z_of
from ..functions.quantiles import exact_quantiles, place_among
from ..sources.tables import written

LEVELS = (0.5, 0.8, 0.9, 0.95)
LOG_2PI = math.log(2 * math.pi)


def point_metrics(y: Column, p: Column) -> list[Column]:
    """n, rmse, mse, mae, bias, mape (rows with y != 0), r2, corr as aggregates. r2 without spread is 1 for no error, else 0."""
    e = p - y
    ss_res, ss_tot = F.sum(e * e), F.var_pop(y) * F.count(y)
    r2 = F.when(ss_tot > 0, 1 - ss_res / ss_tot).when(ss_res == 0, 1.0).otherwise(0.0)
    return [
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        (100.0 * F.avg(F.when(y != 0, F.abs(e / y)))).alias("mape"), r2.alias("r2"),
        F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p)).alias("corr"),
    ]


def scored(df: DataFrame, y: str = "y", mean: str = "mean", std: str = "std", level: float = 0.9) -> DataFrame:
    """Adds the per-row scores nll, crps, dss, pit, interval_score; null where std is missing or not positive.

    The standardised residual and its distribution value are columns of their own, so the scores are short expressions.
    """
    s, q = F.col(std), z_of(level) * F.col(std)
    out = df.withColumn("_z", F.when(s > 0, (F.col(y) - F.col(mean)) / s)).withColumn("pit", F.expr(norm_cdf_sql("_z")))
    z, gap = F.col("_z"), F.col(y) - F.col(mean)
    new = {
        "nll": 0.5 * LOG_2PI + F.log(s) + 0.5 * z * z,
        "crps": s * (z * (2 * F.col("pit") - 1) + 2 * F.expr(norm_pdf_sql("_z")) - 1 / math.sqrt(math.pi)),
        "dss": z * z + 2 * F.log(s),
        "interval_score": 2 * q + 2 / (1 - level) * F.greatest(F.abs(gap) - q, F.lit(0.0)),
    }
    return out.withColumns({n: F.when(s > 0, e) for n, e in new.items()}).drop("_z")


def coverage(y: Column, mean: Column, std: Column, level: float) -> Column:
    """Share of rows within the central interval of this level."""
    return F.avg(F.when(std > 0, (F.abs(y - mean) <= z_of(level) * std).cast("double")))


def probabilistic_metrics(y: str = "y", mean: str = "mean", std: str = "std") -> list[Column]:
    """Aggregates over a scored() table: nll, crps, dss, sharpness, interval score, coverages and calibration error."""
    cover = {x: coverage(F.col(y), F.col(mean), F.col(std), x) for x in LEVELS}
    gap = sum((F.abs(c - x) for x, c in cover.items()), F.lit(0.0)) / len(LEVELS)
    return [
        *[F.avg(n).alias(n) for n in ("nll", "crps", "dss", "interval_score")], F.avg(std).alias("sharpness"),
        *[c.alias(f"coverage_{x * 100:g}") for x, c in cover.items()], gap.alias("calibration_error"),
    ]


def evaluate(df: DataFrame, y: str = "y", mean: str = "mean", std: str = "std", by: list[str] = []) -> DataFrame:  # noqa: B006
    """All metrics by group over rows with all three values, in one pass."""
    rows = df.filter(F.col(y).isNotNull() & F.col(mean).isNotNull() & F.col(std).isNotNull())
    return scored(rows, y, mean, std).groupBy(*by).agg(*point_metrics(F.col(y), F.col(mean)), *probabilistic_metrics(y, mean, std))


def ks_uniform(df: DataFrame, pit: str = "pit") -> DataFrame:
    """One row ks: largest gap between the empirical distribution of the PIT values and the uniform one."""
    # Written first: pushed below the scores, the filter would evaluate their expressions again.
    ranked = global_rank(written(df.select(pit), "pit").filter(F.col(pit).isNotNull()), [pit])
    n = ranked.agg(F.max("rank")).first()[0] or 1
    gap = F.greatest(F.col("rank") / n - F.col(pit), F.col(pit) - (F.col("rank") - 1) / n)
    return ranked.agg(F.max(gap).alias("ks"))


def energy_score(samples: str, y: Column) -> Column:
    """Energy score of an array of samples: mean distance to y less half the mean distance between its two halves."""
    half = F.floor(F.size(samples) / 2).cast("int")
    first, second = F.slice(samples, F.lit(1), half), F.slice(samples, half + 1, half)
    to_y = F.aggregate(samples, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double") - y)) / F.size(samples)
    apart = F.aggregate(F.zip_with(first, second, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x) / half
    return to_y - 0.5 * apart


def compare_models(df: DataFrame, models: list[str], y: str = "y", by: list[str] = []) -> DataFrame:  # noqa: B006
    """Point metrics of several prediction columns, one row per model and group."""
    long = df.unpivot([y, *by], models, "model", "p").filter(F.col(y).isNotNull() & F.col("p").isNotNull())
    return long.groupBy("model", *by).agg(*point_metrics(F.col(y), F.col("p")))


def compare_cases(df: DataFrame, cases: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Metrics of several (y, mean, std column) cases; a case without uncertainty has std null."""
    arms = [F.struct(F.lit(n).alias("case"), F.col(y).alias("y"), F.col(m).alias("mean"), (F.col(s) if s else F.lit(None).cast("double")).alias("std")) for n, (y, m, s) in cases.items()]
    long = df.select(F.explode(F.array(*arms)).alias("c")).select("c.*").filter("y is not null and mean is not null")
    return scored(long).groupBy("case").agg(*point_metrics(F.col("y"), F.col("mean")), *probabilistic_metrics())


def improvement(table: DataFrame, base: str, fused: str, key: str, lower_is_better: list[str], higher_is_better: list[str] = []) -> DataFrame:  # noqa: B006
    """metric, base, fused, percent improvement (null for base 0) between two rows of a metric table."""
    names = [*lower_is_better, *higher_is_better]
    long = table.filter(F.col(key).isin(base, fused)).unpivot([key], names, "metric", "value")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(key) == base, F.col("value"))).alias("base"), F.max(F.when(F.col(key) == fused, F.col("value"))).alias("fused"))
    sign = F.when(F.col("metric").isin(lower_is_better), 1.0).otherwise(-1.0)
    return wide.withColumn("improvement_pct", 100.0 * sign * F.try_divide(F.col("base") - F.col("fused"), F.abs("base")))


def against_mean(df: DataFrame, y: str = "y", mean: str = "mean") -> DataFrame:
    """rmse and mae of the model, of the mean of y, and of the model without its bias."""
    s = df.agg(F.avg(y).alias("_y"), F.avg(F.col(mean) - F.col(y)).alias("_b"))
    e = F.col(mean) - F.col(y)
    cases = {"model": e, "mean_baseline": F.col("_y") - F.col(y), "bias_corrected": e - F.col("_b")}
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("case"), x.alias("e")) for n, x in cases.items()]))
    return df.crossJoin(F.broadcast(s)).select(arms.alias("c")).groupBy("c.case").agg(F.sqrt(F.avg(F.col("c.e") * F.col("c.e"))).alias("rmse"), F.avg(F.abs("c.e")).alias("mae"))


def histogram(df: DataFrame, value: str, bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin, n, expected share and its 95 % band for values in [low, high]; empty bins have 0, the top edge is in the last bin."""
    place = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = out.agg(F.sum("n").alias("_total"))
    share = 1.0 / bins
    out = out.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col("n"), F.col("_total")))
    half = 1.96 * F.sqrt(share * (1 - share) / F.col("_total"))
    return out.select("bin", "n", "share", (share - half).alias("band_low"), (share + half).alias("band_high"))


def reliability(df: DataFrame, levels: tuple[float, ...] = tuple(round(0.1 * i, 1) for i in range(1, 10)) + (0.95,), y: str = "y", mean: str = "mean", std: str = "std") -> DataFrame:
    """level, observed coverage, n and the sampling error of the nominal level."""
    rows = df.filter(F.col(std) > 0)
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[coverage(F.col(y), F.col(mean), F.col(std), x).alias(f"c{i}") for i, x in enumerate(levels)])
    arms = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"c{i}").alias("observed")) for i, x in enumerate(levels)]))
    out = one.select("n", arms.alias("a")).select("a.level", "a.observed", "n")
    return out.withColumn("se", F.sqrt(F.col("level") * (1 - F.col("level")) / F.col("n")))


def error_by_uncertainty(df: DataFrame, bins: int = 5, y: str = "y", mean: str = "mean", std: str = "std") -> DataFrame:
    """bin (by quantiles of std), n, mean std, mean absolute error and its standard error."""
    edges = exact_quantiles(df, std, [i / bins for i in range(1, bins)], name="_q").select("_q")
    place = place_among(F.col("_q"), F.col(std), bins)
    e = F.abs(F.col(y) - F.col(mean))
    out = df.crossJoin(F.broadcast(edges)).withColumn("bin", place).groupBy("bin")
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(std).alias("mean_std"), F.avg(e).alias("mean_abs_error"), (F.stddev_samp(e) / F.sqrt(F.count(F.lit(1)))).alias("se"))
