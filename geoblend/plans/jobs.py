"""Restartable jobs: read, compute, write. A stage whose output is finished is left alone when `resume` is set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, daily, field, metrics, splits
from ..sources import tables


@dataclass(frozen=True)
class DailyJob:
    """Inputs are readings(grid_id, ts, value) by source name, cells(grid_id, latitude, longitude) and priors(grid_id, lur, atmo)."""

    hours: tuple[int, int] | None = None
    window_source: str = "satellite"
    physical: tuple[float, float] = (0.0, 100.0)
    station: str = "station"
    outliers: str = "iqr"
    dense: bool = False
    positive: tuple[str, ...] = ("satellite",)


def build_daily(readings: dict[str, DataFrame], cells: DataFrame, priors: DataFrame, job: DailyJob = DailyJob()) -> DataFrame:
    """The cell-by-day table: cleaned readings of the overpass hours, daily means, stations range-checked and freed of outliers, prior."""
    good = {n: clean.clean_readings(df, positive=n in job.positive) for n, df in readings.items()}
    if job.hours:
        good = {n: clean.in_hours(df, *job.hours) for n, df in good.items()}
    elif job.window_source in good:
        window = clean.overpass_window(good[job.window_source])
        good = {n: clean.in_hours(df, window=window) for n, df in good.items()}
    means = {n: daily.daily_mean(df, n) for n, df in good.items()}
    placed = daily.choose_prior(cells, priors)
    if job.dense:
        out = daily.merge_daily(daily.cell_frame(placed, daily.date_union(list(means.values()))), means)
    else:
        out = daily.sparse_merge(means).join(placed, "grid_id")
    out = out.withColumn(job.station, clean.within(F.col(job.station), *job.physical))
    return clean.treat_outliers(out, job.station, clean.outlier_bounds(out, job.station, job.outliers), "nan")


def run_daily(spark: SparkSession, readings: dict[str, DataFrame], cells: DataFrame, priors: DataFrame, path: str, job: DailyJob = DailyJob(), resume: bool = True) -> DataFrame:
    if not (resume and tables.path_exists(spark, f"{path}/_SUCCESS")):
        tables.write_table(build_daily(readings, cells, priors, job), path, by=["date"])
    return spark.read.parquet(path)


def fit_and_score(rows: DataFrame, sources: list[tables.Source], reference: str, n_space: int = 24, n_time: int = 5, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(predictions at held-out stations, their metrics) of long rows(grid_id, day, x, y, t, source, value, prior)."""
    wide = rows.withColumn("_v", F.when(F.col("source") == reference, F.col("value")))
    held = splits.holdout_cells(wide, "_v", test, seed)
    marked = rows.join(held.withColumn("_h", F.lit(True)), "grid_id", "left")
    train = tables.written(field.with_source(marked.filter(F.col("_h").isNull() | (F.col("source") != reference)), sources).drop("_h"), "job-train")
    f = field.Field(field.even_points(train, n_space, n_time))
    posterior = field.fit(field.information_sums(train, f)[""], f)
    noise = next(s.noise for s in sources if s.name == reference)
    tested = field.predict(marked.filter(F.col("_h") & (F.col("source") == reference)).drop("_h"), posterior, noise=noise)
    return tested, metrics.evaluate(tested, "value")


def sequential_maps(rows: DataFrame, grid: DataFrame, days: list[int], path: str, n_space: int = 24, smooth: bool = True, resume: bool = True) -> DataFrame:
    """Daily maps of grid(grid_id, x, y, prior), written by day, from rows with source parameters."""
    spark = rows.sparkSession
    if not (resume and tables.path_exists(spark, f"{path}/_SUCCESS")):
        states = field.sequential_filter(rows, field.Field(field.even_points(rows, n_space, 1)), days)
        states = field.smooth_states(states) if smooth else states
        frame = grid.crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in days], "day int")))
        tables.write_table(field.predict_states(frame, states), path, by=["day"])
    return spark.read.parquet(path)
