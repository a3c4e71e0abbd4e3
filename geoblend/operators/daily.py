"""The daily cell table: means per cell and day, the frame, and the joins onto it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_mean(df: DataFrame, name: str = "value", value: str = "value") -> DataFrame:
    """grid_id, date, mean of the value: partial sums first, so heavy station cells cost little."""
    return df.groupBy("grid_id", F.to_date("ts").alias("date")).agg(F.avg(value).alias(name))


def hourly_to_daily(df: DataFrame, values: list[str], static: list[str]) -> DataFrame:
    """Daily means of values and each static column's earliest value."""
    return df.groupBy("grid_id", F.to_date("ts").alias("date")).agg(*[F.avg(v).alias(v) for v in values], *[F.min_by(s, "ts").alias(s) for s in static])


def date_union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("date") for f in frames]).distinct()


def cell_frame(cells: DataFrame, dates: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Every cell on every date. The dates are broadcast behind a count (days, not rows)."""
    return cells.crossJoin(F.broadcast(dates) if dates.count() <= limit else dates)


def merge_daily(frame: DataFrame, sources: dict[str, DataFrame], zero: tuple[str, ...] = ("traffic",)) -> DataFrame:
    """Sources left-joined onto the frame by (grid_id, date); missing values of the `zero` sources are 0."""
    out = frame
    for name, df in sources.items():
        out = out.join(df.select("grid_id", "date", name), ["grid_id", "date"], "left")
        if name in zero:
            out = out.withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def sparse_merge(sources: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of the sources: rows where any of them has a value."""
    frames = [df.select("grid_id", "date", name) for name, df in sources.items()]
    return reduce(lambda a, b: a.join(b, ["grid_id", "date"], "full"), frames)


def missing_count(df: DataFrame, column: str = "prior") -> DataFrame:
    """One row n, n_missing: rows, and rows without the column."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("n_missing"))


def attach_observations(predicted: DataFrame, observed: DataFrame, names: list[str], keys: tuple[str, ...] = ("grid_id", "date")) -> DataFrame:
    """Exported grid predictions with the observations of the same cell and day; names that observed lacks are null."""
    have = [n for n in names if n in observed.columns]
    out = predicted.join(observed.select(*keys, *have), list(keys), "left")
    return out.select(*predicted.columns, *[F.col(n) if n in have else F.lit(None).cast("double").alias(n) for n in names])


def choose_prior(cells: DataFrame, priors: DataFrame, first: str = "atmo", second: str = "lur") -> DataFrame:
    """Adds prior: the first choice where present, else the second; and which was taken."""
    out = cells.join(priors, "grid_id", "left").withColumn("prior", F.coalesce(first, second))
    return out.withColumn("prior_source", F.when(F.col(first).isNotNull(), first).when(F.col(second).isNotNull(), second))


def colocated(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by the explicit order: an aggregate, so a heavy key is no single task's window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def baseline_lookup(rows: DataFrame, baseline: DataFrame, value: str, order: list, key: str = "grid_id", name: str = "baseline") -> DataFrame:
    """rows with the baseline's first known value of their key by the order given, or null; each row once."""
    known = first_per_key(baseline.filter(F.col(value).isNotNull()).select(key, F.col(value).alias(name), F.struct(*order).alias("_o")), [key], ["_o"]).drop("_o")
    return rows.join(known, key, "left")


def fill_covariates(frame: DataFrame, covariates: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """Covariates left-joined; gaps are filled with the covariate's overall mean."""
    means = covariates.agg(*[F.avg(n).alias(f"_{n}") for n in names])
    out = frame.join(covariates.select(*on, *names), on, "left").crossJoin(F.broadcast(means))
    return out.select(*frame.columns, *[F.coalesce(n, f"_{n}").alias(n) for n in names])


def to_long(df: DataFrame, sources: list[str], keys: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per present value: keys, kept columns, source, value."""
    return df.unpivot([*keys, *keep], sources, "source", "value").filter("value is not null")


def long_export(df: DataFrame, sources: list[str], keys: list[str], prior: str, pseudo: bool = True) -> DataFrame:
    """Long form with the prior column; with pseudo, the prior also as a source of its own at every row that has it."""
    out = to_long(df, sources, keys, [prior])
    if not pseudo:
        return out
    own = df.filter(F.col(prior).isNotNull()).select(*keys, prior, F.lit(prior).alias("source"), F.col(prior).alias("value"))
    return out.unionByName(own)


def map_ids(df: DataFrame, ids: DataFrame, key: str = "grid_id", name: str = "cell") -> DataFrame:
    """Rows with their integer id from ids(key, name); unmapped rows go."""
    return df.join(ids.select(key, name), key)


def concat(frames: list[DataFrame]) -> DataFrame:
    """Datasets below each other; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def nearest_days(asked: DataFrame, known: DataFrame, date: str = "date") -> DataFrame:
    """date, nearest_day: the known day nearest to each asked day, itself if known; ties go to the earlier.

    Works on the two tables of distinct days: the last known day up to, and the first from, each asked one.
    """
    days = known.select(F.col(date).alias("_day")).distinct().withColumn("_known", F.col("_day"))
    both = days.unionByName(asked.select(F.col(date).alias("_day")).distinct(), allowMissingColumns=True).groupBy("_day").agg(F.max("_known").alias("_known"))
    up_to, on = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_day").rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumns({"_before": F.last("_known", True).over(up_to), "_after": F.first("_known", True).over(on)})
    pick = F.when(F.col("_after").isNull() | (F.datediff("_day", "_before") <= F.datediff("_after", "_day")), F.col("_before")).otherwise(F.col("_after"))
    return asked.select(date).distinct().join(near.select(F.col("_day").alias(date), pick.alias("nearest_day")), date).filter("nearest_day is not null")
