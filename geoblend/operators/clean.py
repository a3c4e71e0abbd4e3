"""Filters, coercions and outlier treatment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

#: Fewer valid points than this give no outlier flags.
LEAST_POINTS = 20


def normalize_id(c: Column) -> Column:
    return F.trim(c.cast("string"))


def clean_readings(df: DataFrame, value: str = "value", positive: bool = False) -> DataFrame:
    """Trimmed id, readable time and value; rows without any of them go, and with positive those not above 0."""
    out = df.withColumn("grid_id", normalize_id(F.col("grid_id"))).withColumn("ts", F.expr("try_cast(ts AS timestamp_ntz)")).withColumn(value, F.expr(f"try_cast(`{value}` AS double)"))
    out = out.filter(F.col("grid_id").isNotNull() & F.col("ts").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    return out.filter(F.col(value) > 0) if positive else out


def overpass_window(df: DataFrame, pad: int = 1, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row start_hour, end_hour: truncated quantiles of the hour, padded, within 0..23."""
    q = df.agg(F.percentile(F.hour("ts"), low).alias("a"), F.percentile(F.hour("ts"), high).alias("b"))
    return q.select(F.greatest(F.col("a").cast("int") - pad, F.lit(0)).alias("start_hour"), F.least(F.col("b").cast("int") + pad, F.lit(23)).alias("end_hour"))


def in_hours(df: DataFrame, start: int | None = None, end: int | None = None, window: DataFrame | None = None) -> DataFrame:
    """Rows of the inclusive hours, fixed or from a one-row overpass_window."""
    if window is None:
        return df.filter(F.hour("ts").between(start, end))
    return df.crossJoin(F.broadcast(window)).filter(F.hour("ts").between(F.col("start_hour"), F.col("end_hour"))).drop("start_hour", "end_hour")


def within(c: Column, low: float, high: float) -> Column:
    """The value, or null outside the physical range."""
    return F.when(c.between(low, high), c)


def outlier_bounds(df: DataFrame, value: str, method: str = "iqr", k: float = 3.0, threshold: float = 4.0) -> DataFrame:
    """One row low, high; nulls (flag nothing) for too few points or no spread."""
    if method == "iqr":
        s = exact_quantiles(df, value, [0.25, 0.75]).select("n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
        spread = F.col("q3") - F.col("q1")
        usable = (F.col("n") >= LEAST_POINTS) & (spread > 0)
        return s.select(F.when(usable, F.col("q1") - k * spread).alias("low"), F.when(usable, F.col("q3") + k * spread).alias("high"))
    if method != "robust":
        raise ValueError(method)
    centre = exact_quantiles(df, value, [0.5]).first()
    n, med = centre["n"], F.lit(centre["q"][0]).cast("double")
    mad = exact_quantiles(df.select(value), F.abs(F.col(value) - med), [0.5]).select(F.lit(n).alias("n"), med.alias("med"), F.col("q")[0].alias("mad"))
    usable = (F.col("n") >= LEAST_POINTS) & (F.col("mad") > 0)
    reach = threshold * F.col("mad") / 0.6745
    return mad.select(F.when(usable, F.col("med") - reach).alias("low"), F.when(usable, F.col("med") + reach).alias("high"))


def treat_outliers(df: DataFrame, value: str, bounds: DataFrame, action: str = "flag") -> DataFrame:
    """flag adds is_outlier; nan blanks, clip limits, drop removes the outliers."""
    out = df.crossJoin(F.broadcast(bounds))
    v = F.col(value)
    bad = F.coalesce((v < F.col("low")) | (v > F.col("high")), F.lit(False))
    if action == "flag":
        out = out.withColumn("is_outlier", bad)
    elif action == "nan":
        out = out.withColumn(value, F.when(~bad, v))
    elif action == "clip":
        out = out.withColumn(value, F.when(F.col("low").isNull() | v.isNull(), v).otherwise(F.least(F.greatest(v, F.col("low")), F.col("high"))))
    elif action == "drop":
        out = out.filter(~bad)
    else:
        raise ValueError(action)
    return out.drop("low", "high")


def keep_sources(df: DataFrame, sources: list[str], others: list[str]) -> DataFrame:
    """Rows where any of the sources is present; the other sources go."""
    some = F.lit(False)
    for s in sources:
        some = some | F.col(s).isNotNull()
    return df.filter(some).drop(*others)


def blank_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn(source, F.lit(None).cast("double"))


def blank_held_out(df: DataFrame, source: str, held: DataFrame, on: list[str], name: str | None = None) -> DataFrame:
    """The source without its values at held-out keys (cells, or cells and dates); held is checked for its size by Spark."""
    marks = held.select(*on).distinct().withColumn("_held", F.lit(True))
    return df.join(marks, on, "left").withColumn(name or source, F.when(F.col("_held").isNull(), F.col(source))).drop("_held")


def closest_day(df: DataFrame, day: str, target: float) -> DataFrame:
    """Rows of the day nearest to target; of two as near, the earlier."""
    days = df.select(day).distinct()
    pick = days.agg(F.min_by(day, F.struct(F.abs(F.col(day) - target), F.col(day))).alias(day))
    return df.join(F.broadcast(pick), day, "left_semi")


def plausibility(df: DataFrame, mean: str = "mean", std: str = "std", limits: tuple[float, float, float, float, float] = (-20.0, 0.0, 200.0, 50.0, 100.0)) -> DataFrame:
    """One row of percentiles of means (2, 50, 98) and stds (50, 98), and whether they keep the limits
    (least of p2, range of the median, most of p98 of the means, most of p98 of the stds)."""
    low, mid_low, high, mid_high, most = limits
    q = exact_quantiles(df, mean, [0.02, 0.5, 0.98], name="m").select("m").crossJoin(exact_quantiles(df, std, [0.5, 0.98], name="s").select("s"))  # one row each
    good = (F.col("m")[0] >= low) & F.col("m")[1].between(mid_low, mid_high) & (F.col("m")[2] <= high) & (F.col("s")[1] <= most)
    return q.select(F.col("m")[0].alias("mean_p2"), F.col("m")[1].alias("mean_p50"), F.col("m")[2].alias("mean_p98"), F.col("s")[0].alias("std_p50"), F.col("s")[1].alias("std_p98"), good.alias("plausible"))


def in_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Rows of a study area."""
    return df.filter(F.col("latitude").between(*lat) & F.col("longitude").between(*lon))
