"""Fitted scalers and their expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scalers:
    """A few dozen fitted numbers: coordinate and time ranges, per-source and per-covariate mean and population std."""

    lat_min: float
    lon_min: float
    scale: float
    day_min: float
    day_range: float
    targets: dict[str, tuple[float, float]] = field(default_factory=dict)
    covariates: dict[str, tuple[float, float]] = field(default_factory=dict)

    def coords(self) -> tuple[Column, Column]:
        return (F.col("latitude") - self.lat_min) / self.scale, (F.col("longitude") - self.lon_min) / self.scale

    def time(self, day: str = "day") -> Column:
        return (F.col(day) - self.day_min) / self.day_range

    def target(self, source: str) -> Column:
        mean, std = self.targets[source]
        return (F.col(source) - mean) / std

    def untarget(self, c: Column, source: str) -> Column:
        mean, std = self.targets[source]
        return c * std + mean

    def covariate(self, name: str) -> Column:
        """Standardised; missing counts as the mean (0)."""
        mean, std = self.covariates[name]
        return F.coalesce((F.col(name) - mean) / std, F.lit(0.0))


def scaler_table(df: DataFrame, sources: list[str], covariates: list[str] = [], day: str = "day") -> DataFrame:  # noqa: B006
    """One row of fitted numbers: ranges (one isotropic scale; zero ranges and stds are 1), means and stds."""
    aggs = [F.min("latitude").alias("lat_min"), F.min("longitude").alias("lon_min"), F.min(day).alias("day_min")]
    width = F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude"))
    span = F.max(day) - F.min(day)
    aggs += [F.when(width > 0, width).otherwise(1.0).alias("scale"), F.when(span > 0, span).otherwise(1.0).alias("day_range")]
    for c in [*sources, *covariates]:
        std = F.stddev_pop(c)
        aggs += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"), F.when(std > 0, std).otherwise(1.0).alias(f"{c}_std")]
    return df.agg(*aggs)


def fit_scalers(df: DataFrame, sources: list[str], covariates: list[str] = [], day: str = "day") -> Scalers:  # noqa: B006
    r = scaler_table(df, sources, covariates, day).first()
    pairs = lambda names: {c: (r[f"{c}_mean"], r[f"{c}_std"]) for c in names}
    return Scalers(r["lat_min"], r["lon_min"], r["scale"], float(r["day_min"]), float(r["day_range"]), pairs(sources), pairs(covariates))


def min_max(df: DataFrame, covariates: list[str], inverted: tuple[str, ...] = ()) -> DataFrame:
    """Covariates to [0, 1], inverted ones as 1 - x; constant ones to 0."""
    s = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in covariates], *[F.max(c).alias(f"_hi_{c}") for c in covariates])
    out = df.crossJoin(F.broadcast(s))
    for c in covariates:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        x = (F.col(c) - lo) / (hi - lo)
        out = out.withColumn(c, F.when(hi > lo, 1.0 - x if c in inverted else x).when(F.col(c).isNotNull(), 0.0))
    return out.drop(*[f"_{e}_{c}" for c in covariates for e in ("lo", "hi")])
