"""Column expressions: geometry, time, scaling, intervals, links, kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import z_of

METRES_PER_DEGREE = 111_320.0
# Bounds of the NO2 classes of the published maps.
NO2_BOUNDS = (0, 5, 8, 10, 12, 15, 18, 22, 28, 40)


def metres_per_degree_lon(lat: Column) -> Column:
    return F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, scale_lat: Column | None = None, per_degree: float = METRES_PER_DEGREE / 1000.0) -> tuple[Column, Column]:
    """(east, north) of point 2 from point 1 in km, with the longitude scale of point 1 or of scale_lat."""
    scale = per_degree * F.cos(F.radians(lat1 if scale_lat is None else scale_lat))
    return (lon2 - lon1) * scale, (lat2 - lat1) * per_degree


def round_even(x: Column, digits: int) -> Column:
    """Rounded by the double's own scaled value, ties to even, as engines of doubles do; bround() goes by the printed digits
    and so rounds 57.605 (scaled 5760.499...) up."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def bearing(east: Column, north: Column) -> Column:
    """Degrees from north, clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def sector_of(angle: Column, sectors: int = 8) -> Column:
    """Index of the sector whose centre is nearest (sector 0 is centred on north)."""
    return F.pmod(F.floor((angle + 180.0 / sectors) / (360.0 / sectors)), F.lit(sectors)).cast("int")


def days_since(ts: Column, start: Column) -> Column:
    """Fractional days from start."""
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400e6


def first_available(columns: list[str], names: tuple[str, ...]) -> Column:
    """The first non-null of those names that the table has."""
    have = [F.col(c) for c in names if c in columns]
    if not have:
        raise ValueError(f"none of {names} in {columns}")
    return F.coalesce(*have)


def interval(mean: Column, std: Column, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> list[Column]:
    """lower_XX and upper_XX of central normal intervals."""
    out = []
    for level in levels:
        z, tag = z_of(level), f"{level * 100:g}"
        out += [(mean - z * std).alias(f"lower_{tag}"), (mean + z * std).alias(f"upper_{tag}")]
    return out


def standardized_residual(y: Column, mean: Column, std: Column) -> Column:
    return (y - mean) / F.greatest(std, F.lit(1e-6))


def variation(mean: Column, std: Column) -> Column:
    """Coefficient of variation within [0, 2]; null where the mean is about zero."""
    return F.when(F.abs(mean) > 1e-9, F.least(F.greatest(std / F.abs(mean), F.lit(0.0)), F.lit(2.0)))


def link(f: Column, slope: Column, intercept: Column) -> Column:
    return slope * f + intercept


def unlink(y: Column, slope: Column, intercept: Column) -> Column:
    return (y - intercept) / slope


def gaussian_log_density(y: Column, mean: Column, variance: Column) -> Column:
    return -0.5 * F.log(2 * math.pi * variance) - F.pow(y - mean, F.lit(2)) / (2 * variance)


def no2_class(value: Column) -> Column:
    """Place of the class whose lower bound is the last not above the value: -1 below all, 9 from the last bound on."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, bound in enumerate(NO2_BOUNDS):
        out = out.when(value < bound, i - 1)
    return out.otherwise(len(NO2_BOUNDS) - 1)


def grid_id(row: Column, col: Column) -> Column:
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def grid_row_col(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "_")
    return F.element_at(parts, 1).cast("int"), F.element_at(parts, 2).cast("int")


def _matern12(d: Column) -> Column:
    return F.exp(-d)


def _matern32(d: Column) -> Column:
    s = math.sqrt(3.0)
    return (1 + s * d) * F.exp(-s * d)


def _matern52(d: Column) -> Column:
    s = math.sqrt(5.0)
    return (1 + s * d + 5.0 / 3.0 * d * d) * F.exp(-s * d)


def _rbf(d: Column) -> Column:
    return F.exp(-0.5 * d * d)


#: Stationary kernels of a scaled distance, by name.
KERNELS: dict[str, Callable[[Column], Column]] = {"matern12": _matern12, "matern32": _matern32, "matern52": _matern52, "rbf": _rbf}


def kernel(name: str, pairs: list[tuple[Column, Column]], scales: list[float], variance: float = 1.0) -> Column:
    """Kernel value of two points given per-dimension columns and length scales (one scale each)."""
    square = sum((((a - b) / s) * ((a - b) / s) for (a, b), s in zip(pairs, scales)), F.lit(0.0))
    return F.lit(variance) * KERNELS[name](F.sqrt(square))
