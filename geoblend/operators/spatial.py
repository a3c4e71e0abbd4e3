"""Grids, spatial joins by bins, interpolation and raster sampling."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import METRES_PER_DEGREE, planar_km
from ..sources.tables import written
from .farfield import idw_sums
from .tiles import stencil, tiled

# --- grids -----------------------------------------------------------------------------------------------------------


def grid_from_bounds(spark: SparkSession, lat_min: float, lat_max: float, lon_min: float, lon_max: float, metres: float) -> DataFrame:
    """k, grid_i, grid_j, latitude, longitude of a regular grid, latitude-major (k = i * n_lon + j)."""
    d_lat = metres / METRES_PER_DEGREE
    d_lon = metres / (METRES_PER_DEGREE * math.cos(math.radians((lat_min + lat_max) / 2)))
    n_lat, n_lon = math.ceil((lat_max - lat_min) / d_lat), math.ceil((lon_max - lon_min) / d_lon)
    cells = spark.range(n_lat * n_lon).select(F.col("id").alias("k"), F.floor(F.col("id") / n_lon).cast("int").alias("grid_i"), (F.col("id") % n_lon).cast("int").alias("grid_j"))
    return cells.withColumn("latitude", lat_min + F.col("grid_i") * d_lat).withColumn("longitude", lon_min + F.col("grid_j") * d_lon)


def grid_from_centre(spark: SparkSession, lat: float, lon: float, width_km: float, height_km: float, metres: float) -> DataFrame:
    half_lat = height_km * 500.0 / METRES_PER_DEGREE
    half_lon = width_km * 500.0 / (METRES_PER_DEGREE * math.cos(math.radians(lat)))
    return grid_from_bounds(spark, lat - half_lat, lat + half_lat, lon - half_lon, lon + half_lon, metres)


def grid_from_values(df: DataFrame) -> DataFrame:
    """latitude x longitude of all distinct values, with the median spacing of each axis."""
    axes = {}
    for c in ("latitude", "longitude"):
        values = df.select(c).distinct()
        gap = values.select((F.col(c) - F.lag(c).over(Window.orderBy(c))).alias("g")).agg(F.median("g").alias(f"d_{c}"))
        axes[c] = values.crossJoin(F.broadcast(gap))
    return axes["latitude"].crossJoin(F.broadcast(axes["longitude"]))


def space_time_frame(grid: DataFrame, times: DataFrame, limit: int = 100_000) -> DataFrame:
    """Every cell at every time; the times are broadcast behind a count."""
    return grid.crossJoin(F.broadcast(times) if times.count() <= limit else times)


# --- bins ------------------------------------------------------------------------------------------------------------


def _bins(lat: Column, lon: Column, size_lat: float, size_lon: float) -> tuple[Column, Column]:
    return F.floor(lat / size_lat).cast("int"), F.floor(lon / size_lon).cast("int")


def _ring(name: str, reach: int) -> Column:
    return F.explode(F.sequence(F.col(name) - reach, F.col(name) + reach))


def radius_join(points: DataFrame, others: DataFrame, km: float, scale_lat: float | None = None, per_degree: float = METRES_PER_DEGREE / 1000.0) -> DataFrame:
    """Pairs with 0 < distance <= km of points(grid_id, latitude, longitude) and others: adds other columns prefixed,
    east, north, km. Longitudes are scaled at the point's latitude, or at scale_lat for all.

    Others are dealt to latitude bands of the radius, and within a band to longitude bins as wide as the radius at its
    end nearer to the pole. A point looks into its band and the two beside it, there into the bins its radius
    reaches, so no pair is lost at any latitude and the join is on the bin. A point whose radius passes the 180th
    meridian looks from a turn away as well; the shorter way round counts.
    """
    band = km / per_degree * (1 + 1e-9)
    name = {c: f"other_{c}" for c in others.columns}
    outer = lambda b: F.least(F.greatest(F.abs(b), F.abs(b + 1)) * band, F.lit(89.4)) if scale_lat is None else F.lit(scale_lat)
    width = lambda b: band / F.cos(F.radians(outer(b)))
    bin_of = lambda lon, b: F.floor(lon / width(b)).cast("int")
    reach = band / F.greatest(F.cos(F.radians(F.col("latitude") if scale_lat is None else F.lit(scale_lat))), F.lit(band / 360.0)) * (1 + 1e-9)
    turns = F.filter(F.array(*[F.col("longitude") + x for x in (0.0, 360.0, -360.0)]), lambda x: (x >= -180.0 - reach) & (x <= 180.0 + reach))
    left = points.withColumn("_lon", F.explode(turns)).withColumn("_bi", F.floor(F.col("latitude") / band).cast("int")).withColumn("_bi", _ring("_bi", 1))
    bins = F.sequence(bin_of(F.col("_lon") - reach, F.col("_bi")), bin_of(F.col("_lon") + reach, F.col("_bi")))
    left = left.withColumn("_bj", F.explode(bins))
    right = others.withColumnsRenamed(name).withColumn("_bi", F.floor(F.col("other_latitude") / band).cast("int"))
    right = right.withColumn("_bj", bin_of(F.col("other_longitude"), F.col("_bi")))
    scale = None if scale_lat is None else F.lit(scale_lat)
    east, north = planar_km(F.col("latitude"), F.col("_lon"), F.col("other_latitude"), F.col("other_longitude"), scale, per_degree)
    gap = F.col("other_longitude") - F.col("_lon")
    joined = left.join(right, ["_bi", "_bj"]).filter((gap > -180.0) & (gap <= 180.0)).withColumns({"east": east, "north": north}).withColumn("km", F.hypot("east", "north"))
    return joined.filter((F.col("km") > 0) & (F.col("km") <= km)).drop("_bi", "_bj", "_lon")


#: Side of radius_sums()' bins in radii, points of a task, and distances that a task computes at once.
WIDE = 4
TASK_POINTS = 20_000
AT_ONCE = 1_000_000


def radius_sums(points: DataFrame, others: DataFrame, km: float, names: list[str], run: Callable[..., list[np.ndarray]], value: str | None = None, scale_lat: float | None = None, per_degree: float = METRES_PER_DEGREE / 1000.0) -> DataFrame:
    """grid_id, n and the sums `names` of each of points(grid_id, latitude, longitude) that has pairs, over the pairs of
    radius_join() with others: run(row, east, north, km, value, rows) gets a run of pairs (row: the point's place among
    `rows`) and returns the sums of each row.

    Pairs are never rows. Others lie in bins of WIDE radii, points are sent to each bin that their radius reaches (about
    two), and a bin adds its pairs up in array steps of at most AT_ONCE distances. The number of tasks follows the points.
    """
    band = km / per_degree * (1 + 1e-9)
    wide = WIDE * band
    near_pole = lambda b: F.least(F.greatest(F.abs(b), F.abs(b + 1)) * wide, F.lit(89.4)) if scale_lat is None else F.lit(scale_lat)
    bin_of = lambda lon, b: F.floor(lon * F.cos(F.radians(near_pole(b))) / wide).cast("int")
    band_of = lambda lat: F.floor(lat / wide).cast("int")
    reach = band / F.greatest(F.abs(F.cos(F.radians(F.col("latitude") if scale_lat is None else F.lit(scale_lat)))), F.lit(band / 360.0)) * (1 + 1e-9)
    placed = lambda df: df.filter("latitude is not null and longitude is not null")
    turns = F.filter(F.array(*[F.col("longitude") + x for x in (0.0, 360.0, -360.0)]), lambda x: (x >= -180.0 - reach) & (x <= 180.0 + reach))
    left = placed(points).withColumn("_lon", F.explode(turns)).withColumn("_bi", F.explode(F.sequence(band_of(F.col("latitude") - band), band_of(F.col("latitude") + band))))
    left = left.withColumn("_bj", F.explode(F.sequence(bin_of(F.col("_lon") - reach, F.col("_bi")), bin_of(F.col("_lon") + reach, F.col("_bi")))))
    left = left.select("_bi", "_bj", F.lit(True).alias("_asks"), "grid_id", F.col("latitude").alias("_lat"), "_lon", F.lit(None).cast("double").alias("_v"))
    right = placed(others).withColumn("_bi", band_of(F.col("latitude"))).withColumn("_bj", bin_of(F.col("longitude"), F.col("_bi")))
    kind = points.schema["grid_id"].dataType
    right = right.select("_bi", "_bj", F.lit(False).alias("_asks"), F.lit(None).cast(kind).alias("grid_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("_v"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["_asks"].to_numpy(dtype=bool)
        own, other = pdf[asks], pdf[~asks].sort_values("_lat")
        if not len(own) or not len(other):
            return pd.DataFrame(columns=["grid_id", "n", *names])
        own = own.iloc[np.lexsort((own["_lon"], np.floor(own["_lat"] / (band / 4))))]
        lat, lon = (own[c].to_numpy(dtype=float) for c in ("_lat", "_lon"))
        o_lat, o_lon, o_v = (other[c].to_numpy(dtype=float) for c in ("_lat", "_lon", "_v"))
        scale = per_degree * np.cos(np.radians(lat if scale_lat is None else np.full(len(lat), scale_lat)))
        far = band / np.maximum(np.abs(scale) / per_degree, band / 360.0) * (1 + 1e-9)
        sums, at = np.zeros((1 + len(names), len(own))), 0
        while at < len(own):
            end = min(at + 256, len(own))
            a = np.searchsorted(o_lat, lat[at:end].min() - band, side="left")
            b = np.searchsorted(o_lat, lat[at:end].max() + band, side="right")
            near = a + np.flatnonzero((o_lon[a:b] >= (lon[at:end] - far[at:end]).min()) & (o_lon[a:b] <= (lon[at:end] + far[at:end]).max()))
            end = min(end, at + max(1, AT_ONCE // max(len(near), 1)))
            gap = o_lon[near] - lon[at:end, None]
            east, north = gap * scale[at:end, None], (o_lat[near] - lat[at:end, None]) * per_degree
            d = np.sqrt(east * east + north * north)
            i, j = np.nonzero((d > 0) & (d <= km) & (gap > -180.0) & (gap <= 180.0))
            sums[:, at:end] = [np.bincount(i, minlength=end - at), *run(i, east[i, j], north[i, j], d[i, j], o_v[near[j]], end - at)]
            at = end
        met = sums[0] > 0
        return pd.DataFrame({"grid_id": own["grid_id"].to_numpy()[met], "n": sums[0, met].astype(np.int64)} | {name: x[met] for name, x in zip(names, sums[1:])})

    tasks = -(-points.count() // TASK_POINTS) or 1
    dealt = left.unionByName(right).repartition(tasks, "_bi", "_bj")
    schema = f"grid_id {kind.simpleString()}, n long" + "".join(f", `{x}` double" for x in names)
    met = dealt.groupBy("_bi", "_bj").applyInPandas(meet, schema).repartition(tasks, "grid_id")
    return met.groupBy("grid_id").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def nearest_join(queries: DataFrame, points: DataFrame, size: tuple[float, float], values: list[str], id_col: str = "grid_id", most: float | None = None, default: float | None = None) -> DataFrame:
    """Each query's nearest point in degrees (ties by id): adds near_id, distance and the values; exact, one row per query,
    whatever its columns hold: queries are numbered.

    First a query looks into its bin and the eight around; a match no farther than a bin counts. Queries left over
    descend a tree of bins, each sixteen of the level below with the box of its points: of the children reached,
    those no farther than the least upper bound of any stay. So far queries and empty surroundings cost a few rows a
    level. Queries without a finite place, or with no points at all, have nulls; values beyond `most` degrees or
    missing become `default` if one is given.
    """
    s_lat, s_lon = size
    a, b = _bins(F.col("latitude"), F.col("longitude"), s_lat, s_lon)
    pts = points.select(F.col(id_col).alias("near_id"), F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon"), *values).filter("_plat is not null and _plon is not null")
    pa_, pb_ = _bins(F.col("_plat"), F.col("_plon"), s_lat, s_lon)
    pts = written(pts.withColumns({"_bi": pa_, "_bj": pb_}), "nearest-points")
    asked = written(queries.withColumns({"_bi": a, "_bj": b, "_q": F.monotonically_increasing_id()}), "nearest-queries")
    d = F.hypot(F.col("_plat") - F.col("latitude"), F.col("_plon") - F.col("longitude"))
    pick = F.min_by(F.struct("near_id", "distance", *values), F.struct("distance", "near_id")).alias("_b")

    def met(look: DataFrame) -> DataFrame:
        return look.join(pts, ["_bi", "_bj"]).withColumn("distance", d).groupBy("_q").agg(pick)

    place = asked.select("_q", "latitude", "longitude", "_bi", "_bj")
    sure = written(met(place.withColumn("_bi", _ring("_bi", 1)).withColumn("_bj", _ring("_bj", 1))).filter(F.col("_b.distance") <= min(s_lat, s_lon)), "nearest-sure")
    todo = written(place.filter("latitude is not null and longitude is not null").join(sure.select("_q"), "_q", "left_anti").drop("_bi", "_bj"), "nearest-left")
    found = sure
    if todo.take(1):
        boxes = [written(pts.groupBy("_bi", "_bj").agg(F.min("_plat").alias("_s"), F.max("_plat").alias("_n"), F.min("_plon").alias("_w"), F.max("_plon").alias("_e")), "nearest-boxes")]
        while boxes[-1].count() > 16:
            up = boxes[-1].groupBy(F.floor(F.col("_bi") / 4).cast("int").alias("_bi"), F.floor(F.col("_bj") / 4).cast("int").alias("_bj"))
            boxes.append(written(up.agg(F.min("_s").alias("_s"), F.max("_n").alias("_n"), F.min("_w").alias("_w"), F.max("_e").alias("_e")), "nearest-boxes"))
        tops = boxes[-1].select(F.collect_list(F.struct("_bi", "_bj", "_s", "_n", "_w", "_e")).alias("_t"))  # one row of at most 16
        look = todo.crossJoin(F.broadcast(tops)).withColumn("_t", F.explode("_t")).select("_q", "latitude", "longitude", "_t.*")
        for below in [*boxes[-2::-1], None]:
            gap = lambda lo, hi, x: F.greatest(F.col(lo) - F.col(x), F.col(x) - F.col(hi), F.lit(0.0))
            far = lambda lo, hi, x: F.greatest(F.abs(F.col(lo) - F.col(x)), F.abs(F.col(x) - F.col(hi)))
            look = look.withColumn("_low", F.hypot(gap("_s", "_n", "latitude"), gap("_w", "_e", "longitude")))
            look = look.withColumn("_up", F.min(F.hypot(far("_s", "_n", "latitude"), far("_w", "_e", "longitude"))).over(Window.partitionBy("_q")))
            look = look.filter(F.col("_low") <= F.col("_up") * (1 + 1e-9)).select("_q", "latitude", "longitude", "_bi", "_bj")
            if below is not None:
                parent = below.withColumns({"_pi": F.floor(F.col("_bi") / 4).cast("int"), "_pj": F.floor(F.col("_bj") / 4).cast("int")})
                look = look.withColumnsRenamed({"_bi": "_pi", "_bj": "_pj"}).join(parent, ["_pi", "_pj"]).drop("_pi", "_pj")
        found = sure.unionByName(met(look))
    out = asked.drop("_bi", "_bj").join(found, "_q", "left").select(*queries.columns, "_b.*")
    if default is None:
        return out
    known = F.lit(True) if most is None else F.col("distance") <= most
    return out.withColumns({v: F.coalesce(F.when(known, F.col(v)), F.lit(default)) for v in values})


def nearest_on_grid(queries: DataFrame, grid: DataFrame, origin: tuple[float, float], step: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """The nearest cell of a regular grid by index arithmetic: joins on (grid_i, grid_j)."""
    i = F.least(F.greatest(F.round((F.col("latitude") - origin[0]) / step[0]).cast("int"), F.lit(0)), F.lit(shape[0] - 1))
    j = F.least(F.greatest(F.round((F.col("longitude") - origin[1]) / step[1]).cast("int"), F.lit(0)), F.lit(shape[1] - 1))
    return queries.withColumns({"grid_i": i, "grid_j": j}).join(grid.drop("latitude", "longitude"), ["grid_i", "grid_j"], "left")


def snap_stations(stations: DataFrame, points: DataFrame, size: tuple[float, float], most: float) -> DataFrame:
    """The nearest cell of each station, without stations farther than `most` degrees from any."""
    return nearest_join(stations, points, size, []).filter(F.col("distance") <= most)


# --- interpolation ---------------------------------------------------------------------------------------------------


def _idw_sums(lat: np.ndarray, lon: np.ndarray, pts: np.ndarray, power: float, exact: float, scale: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cells against points (latitude, longitude, value): sums of weights, of weighted values, and the first point at the cell (-1: none)."""
    w_sum, wv_sum, hit = np.zeros(len(lat)), np.zeros(len(lat)), np.full(len(lat), -1)
    for at in range(0, len(lat) if len(pts) else 0, 1024):
        own = slice(at, at + 1024)
        d = np.hypot((pts[None, :, 0] - lat[own, None]) * scale[0], (pts[None, :, 1] - lon[own, None]) * scale[1])
        near = d < exact
        w = np.where(near, 1.0, d + near) ** -power
        w_sum[own], wv_sum[own] = w.sum(axis=1), (w * pts[:, 2]).sum(axis=1)
        hit[own] = np.where(near.any(axis=1), near.argmax(axis=1), -1)
    return w_sum, wv_sum, hit


def idw(grid: DataFrame, points: DataFrame, key: str, power: float = 2.0, exact: float = 1e-10, limit: int = 5_000, km: float | None = None, default: float | None = None) -> DataFrame:
    """Adds value: inverse-distance weights of all points(ord, latitude, longitude, value); a point at the cell gives its
    value (the least ord). Distances are in degrees, or in km with `km` a degree, longitudes scaled at the points' mean
    latitude. Up to `limit` points go with the tasks; more are met through a tree of boxes (farfield), those near a cell one
    by one and those farther out by sums whose error is below 1e-8 of the weights. key tells the cells apart."""
    points = points.select("ord", "latitude", "longitude", "value").filter("latitude is not null and longitude is not null and value is not null")
    n, mean_lat = points.agg(F.count(F.lit(1)), F.avg("latitude")).first()
    scale = (km, km * math.cos(math.radians(mean_lat or 0.0))) if km else (1.0, 1.0)
    empty = np.nan if default is None else default
    if n > limit:
        placed = written(grid.withColumn("_id", F.monotonically_increasing_id()), "idw-cells")
        sums = idw_sums(placed.select("_id", "latitude", "longitude"), points, n, power, exact, scale)
        value = F.when(F.col("_hit"), F.col("_at")).otherwise(F.try_divide(F.col("_wv"), F.col("_w")))
        out = placed.join(sums.select("_id", value.alias("value")), "_id", "left")
        return out.select(*grid.columns, F.col("value") if default is None else F.coalesce("value", F.lit(default)).alias("value"))
    rows = points.orderBy("ord", "latitude", "longitude", "value").collect()
    pts = np.array([(r["latitude"], r["longitude"], r["value"]) for r in rows], dtype=float).reshape(-1, 3)

    def run(batches):
        for pdf in batches:
            lat, lon = (pdf[c].to_numpy(dtype=float) for c in ("latitude", "longitude"))
            w, wv, hit = _idw_sums(lat, lon, pts, power, exact, scale)
            out = np.full(len(pdf), empty)
            np.divide(wv, w, out=out, where=w > 0)
            out = np.where(hit >= 0, pts[hit, 2], out) if len(pts) else out
            yield pdf.assign(value=pd.Series(out, index=pdf.index).astype("Float64").mask(np.isnan(out)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema) + ", value double"
    return grid.mapInPandas(run, schema)


def fill_missing(df: DataFrame, value: str, method: str = "mean", constant: float = 0.0, size: tuple[float, float] = (0.01, 0.01), key: str = "grid_id") -> DataFrame:
    """Missing values filled by the overall mean, a constant, or the nearest known cell's value."""
    if method == "constant":
        return df.withColumn(value, F.coalesce(value, F.lit(constant)))
    if method == "mean":
        return df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("_m")))).withColumn(value, F.coalesce(value, "_m")).drop("_m")
    if method != "nearest":
        raise ValueError(method)
    known, gaps = df.filter(F.col(value).isNotNull()), df.filter(F.col(value).isNull())
    near = nearest_join(gaps.drop(value), known, size, [value], id_col=key).select(*df.columns)
    return known.unionByName(near)  # with nothing known, gaps stay


# --- rasters ---------------------------------------------------------------------------------------------------------


def raster_position(x: Column, y: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """(column, row) of places by a raster's affine (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f, of pixel
    corners; whole numbers are pixel centres, as the samplers take them."""
    a, b, c, d, e, f = transform
    scale = a * e - b * d
    if scale == 0:
        raise ValueError("the affine cannot be inverted")
    return (e * (x - c) - b * (y - f)) / scale - 0.5, (a * (y - f) - d * (x - c)) / scale - 0.5


def bilinear_sample(points: DataFrame, raster: DataFrame, key: str, x: Column, y: Column, default: float | None = None) -> DataFrame:
    """key, value: bilinear of the four raster(row, col, value) corners around (x = column, y = row) positions; null, or
    the default, outside the raster or at a corner without value."""
    corners = F.array(*[F.struct((F.floor(y) + dy).cast("int").alias("row"), (F.floor(x) + dx).cast("int").alias("col"),
                                 ((1 - F.abs(x - F.floor(x) - dx)) * (1 - F.abs(y - F.floor(y) - dy))).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    asked = points.select(key, F.explode(corners).alias("_k")).select(key, "_k.*")
    hits = asked.join(raster.filter("value is not null"), ["row", "col"], "left")
    value = F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value")))
    return hits.groupBy(key).agg((value if default is None else F.coalesce(value, F.lit(default))).alias("value"))


def nearest_sample(points: DataFrame, raster: DataFrame, key: str, x: Column, y: Column, default: float | None = None) -> DataFrame:
    """key, value: the pixel nearest to (x = column, y = row) positions; outside the raster or without value null, or the default."""
    asked = points.select(key, F.round(y).cast("int").alias("row"), F.round(x).cast("int").alias("col"))
    return asked.join(raster, ["row", "col"], "left").select(key, F.col("value") if default is None else F.coalesce("value", F.lit(default)).alias("value"))


def resample(raster: DataFrame, factor: int, method: str = "average") -> DataFrame:
    """Coarser raster: average, nearest (the pixel at the coarse cell's centre) or mode (ties to the least value) of factor x factor pixels."""
    cell = raster.withColumns({"_r": F.floor(F.col("row") / factor).cast("int"), "_c": F.floor(F.col("col") / factor).cast("int")})
    if method == "average":
        out = cell.groupBy("_r", "_c").agg(F.avg("value").alias("value"))
    elif method == "nearest":
        mid = factor // 2
        out = cell.filter((F.col("row") % factor == mid) & (F.col("col") % factor == mid)).select("_r", "_c", "value")
    elif method == "mode":
        counts = cell.groupBy("_r", "_c", "value").agg(F.count(F.lit(1)).alias("n"))
        out = counts.groupBy("_r", "_c").agg(F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("value"))
    else:
        raise ValueError(method)
    return out.withColumnsRenamed({"_r": "row", "_c": "col"})


def gaussian_smooth(raster: DataFrame, by: list[str] = [], sigma: float = 0.6, radius: int = 2, support: str | None = None) -> DataFrame:  # noqa: B006
    """Gaussian-weighted mean of each pixel's neighbourhood, gaps first filled with the median, edges reflected.

    by: further keys (such as the day); the raster's extent is taken over the whole table. support: a boolean column;
    pixels outside count as gaps and stay null.
    """
    inside = F.coalesce(F.col(support), F.lit(False)) if support else F.lit(True)
    pixels = raster.select(*by, "row", "col", F.when(inside, F.col("value")).alias("value"), inside.alias("_in"))
    top, right, gaps = pixels.agg(F.max("row"), F.max("col"), F.count_if(F.col("value").isNull())).first()
    filled = pixels.select(*by, "row", "col", "value")
    if gaps:
        medians = exact_quantiles(pixels, "value", [0.5], by, "_med").select(*by, F.col("_med")[0].alias("_med"))
        met = pixels.join(F.broadcast(medians), by, "left") if by else pixels.crossJoin(F.broadcast(medians))
        filled = met.select(*by, "row", "col", F.coalesce("value", "_med").alias("value"))
    total = sum(math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1))
    weight = np.array([math.exp(-0.5 * (d / sigma) ** 2) / total for d in range(-radius, radius + 1)])

    def smooth(block: np.ndarray, row: int, col: int) -> list[np.ndarray]:
        def reflected(first: int, last: int) -> np.ndarray:
            at = np.arange(first - radius, first - radius + len(block))
            at = np.where(at < 0, -at - 1, np.where(at > last, 2 * last + 1 - at, at))
            return np.clip(at - (first - radius), 0, len(block) - 1)  # beyond a rim past the edge nothing is read

        x = block[np.ix_(reflected(row, top), reflected(col, right))]
        known = ~np.isnan(x)
        x, side = np.where(known, x, 0.0), len(block) - 2 * radius
        above, below = np.zeros((side, side)), np.zeros((side, side))
        for i, a in enumerate(weight):
            for j, b in enumerate(weight):
                own = (slice(i, i + side), slice(j, j + side))
                above, below = above + a * b * x[own], below + a * b * known[own]
        return [np.divide(above, below, out=np.full((side, side), np.nan), where=below > 0)]

    out = stencil(tiled(filled, by), by, radius, ["value"], smooth)
    if not support and not gaps:
        return out
    # Pixels without any value to smooth have no row there; those outside the support stay null.
    keep = pixels.select(*by, "row", "col", "_in")
    return keep.join(out, [*by, "row", "col"], "left").select(*by, "row", "col", F.when(F.col("_in"), F.col("value")).alias("value"))
