"""Tables behind reports: cross-validation summaries, daily series, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def loso_summary(df: DataFrame, metrics: list[str] = ["rmse", "mae"]) -> DataFrame:  # noqa: B006
    """Per model: stations, mean and median of each metric, mean absolute bias."""
    aggs = [F.count(F.lit(1)).alias("n_stations")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.median(m).alias(f"median_{m}")]
    return df.groupBy("model").agg(*aggs, F.avg(F.abs("bias")).alias("mean_abs_bias"))


def loso_winner(df: DataFrame, models: list[str], metric: str = "rmse", differences: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """station, the metric of each model, a_minus_b for the differences asked for, and the model with the least (ties by name)."""
    wide = df.groupBy("station").pivot("model", models).agg(F.first(metric))
    wide = wide.withColumns({f"{a}_minus_{b}": F.col(a) - F.col(b) for a, b in differences})
    best = df.groupBy("station").agg(F.min_by("model", F.struct(F.col(metric), F.col("model"))).alias("winner"))
    return wide.join(best, "station")


def pooled(df: DataFrame) -> DataFrame:
    """Count-weighted rmse, mae and bias of each model over stations."""
    weight = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return df.groupBy("model").agg(F.sum("n").alias("n"), F.sqrt(weight("mse")).alias("rmse"), weight("mae").alias("mae"), weight("bias").alias("bias"))


def fold_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, std, min, max over folds."""
    long = df.unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def domain_average(df: DataFrame, day: str = "day") -> DataFrame:
    return df.groupBy(day).agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def daily_observed(df: DataFrame, day: str = "day", y: str = "y", mean: str = "mean") -> DataFrame:
    """Per day its ordinal, count and mean observed and predicted value. The ordinal is taken on the table of days."""
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("observed"), F.avg(mean).alias("predicted"))
    return days.withColumn("ordinal", F.row_number().over(Window.orderBy(day)))


def station_fits(df: DataFrame, models: list[str], station: str = "station", y: str = "y") -> DataFrame:
    """Linear fit of station mean predictions on station mean observations, per model."""
    means = df.groupBy(station).agg(F.avg(y).alias("y"), *[F.avg(m).alias(m) for m in models])
    long = means.unpivot([station, "y"], models, "model", "p")
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("p", "y").alias("slope"), F.regr_intercept("p", "y").alias("intercept"), F.regr_r2("p", "y").alias("r2"),
        F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2)))).alias("rmse"),
    )


def clip_limits(df: DataFrame, value: str, by: list[str] = [], low: float = 0.02, high: float = 0.98) -> DataFrame:  # noqa: B006
    """Quantiles of all values, or of each group's."""
    return exact_quantiles(df, value, [low, high], by).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def grid_profile(df: DataFrame, ts: str = "date", threshold: float = 0.5) -> DataFrame:
    """One row: distinct cells and times, coverage of the dense frame, repeats per (cell, time), gridded flag."""
    slots = df.groupBy("grid_id", ts).agg(F.count(F.lit(1)).alias("k"))
    s = slots.agg(F.countDistinct("grid_id").alias("n_cells"), F.countDistinct(ts).alias("n_times"), F.count(F.lit(1)).alias("n_slots"), F.avg("k").alias("repeat_mean"), F.stddev_pop("k").alias("repeat_std"), F.min("k").alias("repeat_min"), F.max("k").alias("repeat_max"))
    s = s.withColumn("coverage", F.try_divide(F.col("n_slots"), F.col("n_cells") * F.col("n_times")))
    return s.withColumn("gridded", F.coalesce(F.col("coverage") > threshold, F.lit(False)))


def source_statistics(df: DataFrame, sources: list[str], reference: str) -> DataFrame:
    """Per source: n, mean, std, min, max, and mean difference to the reference where both are present."""
    others = df.unpivot([F.col(reference).alias("_ref")], sources, "source", "value").filter("value is not null")
    return others.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(F.col("value") - F.col("_ref")).alias("mean_difference"),
    )


def day_counts(df: DataFrame, sources: list[str], day: str = "date") -> DataFrame:
    return df.groupBy(day).agg(*[F.count(s).alias(f"n_{s}") for s in sources])


def top_sites(df: DataFrame, source: str, n: int = 5, cell: str = "grid_id") -> DataFrame:
    """The n cells with most values of the source (ties by cell)."""
    return df.filter(F.col(source).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), cell).limit(n)


def knee(sweep: DataFrame, size: str = "m", error: str = "rmse", seconds: str = "seconds") -> DataFrame:
    """One row, the knee of a sweep: largest second difference of the run time if errors differ by under 0.5, else the
    size where the error changes most per step. The sweep is a few rows."""
    w, everything = Window.orderBy(size), Window.partitionBy()
    second = F.lead(seconds).over(w) - 2 * F.col(seconds) + F.lag(seconds).over(w)
    slope = F.abs((F.col(error) - F.lag(error).over(w)) / (F.col(size) - F.lag(size).over(w)))
    flat = (F.max(error).over(everything) - F.min(error).over(everything)) < 0.5
    rows = sweep.withColumn("bend", F.when(flat, second).otherwise(slope))
    return rows.filter("bend is not null").agg(F.max_by(size, F.struct(F.col("bend"), -F.col(size))).alias("knee"), F.max("bend").alias("bend"))


def every_nth(df: DataFrame, step: Column, rank: str = "rank") -> DataFrame:
    """Rows whose 1-based rank minus 1 is a multiple of step."""
    return df.filter((F.col(rank) - 1) % step == 0)
