"""Upwind sums over neighbouring cells and wind-weighted covariates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import radius_sums
from .tiles import SIDE, stencil, tiled

SECTORS = 8


#: Kilometres per degree of the upwind distances (fixed value).
KM_PER_DEGREE = 111.0


def upwind_sums(cells: DataFrame, traffic: DataFrame, km: float = 3.0) -> DataFrame:
    """grid_id, upwind_0..7: per sector, the sum of traffic / d^2 over cells within km whose bearing is within 22.5
    degrees of the sector's centre (both edges counted). Traffic of 0 or none counts as 1. Longitudes are scaled at the
    mean latitude of the distinct places.
    """
    mean_lat = cells.select("latitude", "longitude").distinct().agg(F.avg("latitude")).first()[0] or 0.0
    weight = F.when(F.coalesce(F.col("traffic"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("traffic"))
    sources = cells.join(traffic.select("grid_id", "traffic"), "grid_id", "left").select("grid_id", "latitude", "longitude", weight.alias("t"))
    centre = 360.0 / SECTORS

    def by_sector(row: np.ndarray, east: np.ndarray, north: np.ndarray, d: np.ndarray, value: np.ndarray, rows: int) -> list[np.ndarray]:
        angle, w = np.degrees(np.arctan2(east, north)) % 360.0, value / (d * d)
        off = lambda k: np.abs((angle - k * centre + 180.0) % 360.0 - 180.0)
        return [np.bincount(row, np.where(off(k) <= centre / 2, w, 0.0), rows) for k in range(SECTORS)]

    names = [f"upwind_{k}" for k in range(SECTORS)]
    sums = radius_sums(cells.select("grid_id", "latitude", "longitude"), sources, km, names, by_sector, "t", mean_lat, KM_PER_DEGREE)
    return sums.select("grid_id", *names)


def upwind_on_grid(cells: DataFrame, traffic: DataFrame, step: tuple[float, float], km: float = 3.0, row: str = "r", col: str = "c") -> DataFrame:
    """upwind_sums() of cells that are pixels of a grid of `step` degrees (latitude by row, longitude by column): the same
    sums as stencils over tiles, a fixed weight for each offset and sector, instead of a row for each pair."""
    mean_lat = cells.select("latitude", "longitude").distinct().agg(F.avg("latitude")).first()[0] or 0.0
    north, east = step[0] * KM_PER_DEGREE, step[1] * KM_PER_DEGREE * math.cos(math.radians(mean_lat))
    reach = max(int(km / north), int(km / east)) + 1
    taps = []
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            d = math.hypot(i * north, j * east)
            if 0 < d <= km:
                angle = math.degrees(math.atan2(j * east, i * north)) % 360.0
                sectors = [k for k in range(SECTORS) if abs((angle - k * 360.0 / SECTORS + 180.0) % 360.0 - 180.0) <= 180.0 / SECTORS]
                taps.append((i + reach, j + reach, 1.0 / d**2, sectors))

    def run(block: np.ndarray, i0: int, j0: int) -> list[np.ndarray]:
        side, known = len(block) - 2 * reach, ~np.isnan(block)
        t, out = np.where(known, block, 0.0), np.zeros((SECTORS + 1, side, side))
        for i, j, w, sectors in taps:
            own = t[i : i + side, j : j + side] * w
            for k in sectors:
                out[k] += own
            out[SECTORS] += known[i : i + side, j : j + side]
        return list(out)

    weight = F.when(F.coalesce(F.col("traffic"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("traffic"))
    pixels = cells.join(traffic.select("grid_id", "traffic"), "grid_id", "left").groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.sum(weight).alias("value"))
    side = max(SIDE, reach)
    names = [f"upwind_{k}" for k in range(SECTORS)]
    sums = stencil(tiled(pixels, [], side=side), [], reach, [*names, "_near"], run, side).filter(F.col("_near") > 0)
    return cells.select("grid_id", F.col(row).alias("row"), F.col(col).alias("col")).join(sums, ["row", "col"]).select("grid_id", *names)


def wind_weights() -> dict[str, Column]:
    """traffic_wind_k = upwind_k * freq_k and speed_freq_k = speed_k * freq_k of (upwind, freq, speed) rows; missing is 0."""
    new = {}
    for k in range(SECTORS):
        freq = F.coalesce(f"freq_{k}", F.lit(0.0))
        new[f"traffic_wind_{k}"] = F.coalesce(f"upwind_{k}", F.lit(0.0)) * freq
        new[f"speed_freq_{k}"] = F.coalesce(f"speed_{k}", F.lit(0.0)) * freq
    return new


def wind_weighted(days: DataFrame, upwind: DataFrame) -> DataFrame:
    """wind_weights() of (grid_id, date, freq, speed) rows."""
    new = wind_weights()
    return days.join(upwind, "grid_id", "left").withColumns(new).select("grid_id", "date", *new)
