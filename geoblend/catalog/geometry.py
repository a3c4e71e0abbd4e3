"""Queries of grids, spatial joins, interpolation and rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import covering, daily, spatial
from ..sources import roles as R
from ..sources import tables
from .etl import daily_sparse
from .registry import query, roles, rounded


def station_points(spark, sf_dir: str) -> DataFrame:
    """station, latitude, longitude (off the grid), value: mean of each station cell."""
    means = R.hourly(spark, sf_dir, "station").groupBy("grid_id").agg(F.avg("value").alias("value"))
    return means.join(R.cells(spark, sf_dir), "grid_id").select(F.col("grid_id").alias("station"), (F.col("latitude") + 0.0003).alias("latitude"), (F.col("longitude") + 0.0004).alias("longitude"), "value")


STATIONS = "stations AS (SELECT c.grid_id AS station, latitude + 0.0003e0 AS latitude, longitude + 0.0004e0 AS longitude, v AS value FROM (SELECT grid_id, avg(value) AS v FROM hourly WHERE kind = 'station' GROUP BY grid_id) m JOIN cells c USING (grid_id))"
NEAREST = "nn AS (SELECT station, s.value, arg_min(c.grid_id, (d, c.grid_id)) AS near_id, min(d) AS distance FROM (SELECT s.station, s.value, c.grid_id, sqrt((c.latitude - s.latitude) ** 2 + (c.longitude - s.longitude) ** 2) AS d FROM stations s, cells c) s JOIN cells c USING (grid_id) GROUP BY station, s.value)"


@query(roles("cells", "hourly") + f", {STATIONS}, p AS (SELECT station, c.grid_id, sqrt((c.latitude - s.latitude) ** 2 + (c.longitude - s.longitude) ** 2) AS d FROM stations s, cells c) SELECT station, arg_min(grid_id, d) AS near_id, round(min(d), 9) AS distance FROM p GROUP BY station")
def nearest_cell(spark, sf_dir: str) -> DataFrame:
    out = spatial.nearest_join(station_points(spark, sf_dir), R.cells(spark, sf_dir), (0.001, 0.0015), [])
    return rounded(out.select("station", "near_id", "distance"), 9)


@query(roles("cells", "hourly") + f", {STATIONS}, f AS (SELECT station, latitude + 0.0002e0 * (split_part(station, '_', 2)::INT % 9) AS latitude, longitude FROM stations), p AS (SELECT station, k.grid_id, sqrt((k.latitude - s.latitude) ** 2 + (k.longitude - s.longitude) ** 2) AS d FROM f s, cells k) SELECT station, arg_min(grid_id, d) AS near_id FROM p GROUP BY station HAVING min(d) <= 0.0006e0")
def snapped_stations(spark, sf_dir: str) -> DataFrame:
    """Stations moved off their cells and snapped to all cells, those too far from any dropped."""
    moved = station_points(spark, sf_dir).withColumn("latitude", F.col("latitude") + 0.0002 * (F.split("station", "_")[1].cast("int") % 9))
    return spatial.snap_stations(moved, R.cells(spark, sf_dir), (0.001, 0.0015), 0.0006).select("station", "near_id")


@query(roles("cells") + """, p AS (SELECT a.grid_id, b.grid_id AS o, sqrt(((b.longitude - a.longitude) * 111320e0 * cos(radians(a.latitude)) / 1000e0) ** 2 + ((b.latitude - a.latitude) * 111320e0 / 1000e0) ** 2) AS km FROM cells a, cells b)
    SELECT grid_id, count(*) AS n, round(sum(km), 6) AS total_km FROM p WHERE km > 0 AND km <= 3e0 GROUP BY grid_id""")
def radius_pairs(spark, sf_dir: str) -> DataFrame:
    cells = R.cells(spark, sf_dir).select("grid_id", "latitude", "longitude")
    return rounded(spatial.radius_sums(cells, cells, 3.0, ["total_km"], lambda row, east, north, km, value, rows: [np.bincount(row, km, rows)]))


@query(roles("cells") + """, p AS (SELECT grid_id, (SELECT min(c) FROM cells) AS z, r, c, 111320e0 * cos(radians(latitude)) AS m, (longitude + 6.36e0) * 111320e0 * cos(radians(53.25e0)) / 1000e0 AS e, (latitude - 53.25e0) * 111320e0 / 1000e0 AS n FROM cells)
    SELECT grid_id, round(m, 4) AS metres, round(sqrt(e * e + n * n), 6) AS km, round((degrees(atan2(e, n)) + 360e0) % 360e0, 6) AS bearing, (floor(((degrees(atan2(e, n)) + 360e0) % 360e0 + 22.5e0) / 45e0)::INT % 8) AS sector, split_part(grid_id, '_', 1)::INT AS row, split_part(grid_id, '_', 2)::INT AS col FROM p""")
def geometry(spark, sf_dir: str) -> DataFrame:
    """Distance, bearing and sector of every cell from one point, metres per degree, and id parts."""
    lat, lon = F.lit(53.25), F.lit(-6.36)
    e, n = scalars.planar_km(lat, lon, F.col("latitude"), F.col("longitude"))
    row, col = scalars.grid_row_col(F.col("grid_id"))
    angle = scalars.bearing(e, n)
    return rounded(R.cells(spark, sf_dir).select("grid_id", scalars.metres_per_degree_lon(F.col("latitude")).alias("metres"), F.hypot(e, n).alias("km"), angle.alias("bearing"), scalars.sector_of(angle).alias("sector"), row.alias("row"), col.alias("col")), metres=4)


@query(roles("cells", "hourly") + f", {STATIONS}, w AS (SELECT c.grid_id, s.value, 1e0 / ((c.latitude - s.latitude) ** 2 + (c.longitude - s.longitude) ** 2) AS w FROM cells c, stations s) SELECT grid_id, round(sum(w * value) / sum(w), 6) AS value FROM w GROUP BY grid_id")
def idw(spark, sf_dir: str) -> DataFrame:
    points = station_points(spark, sf_dir).withColumnRenamed("station", "ord")
    return rounded(spatial.idw(R.cells(spark, sf_dir), points, "grid_id").select("grid_id", "value"))


@query(roles("cells", "priors", "hourly") + f""", {STATIONS}, p AS (SELECT latitude, longitude, lur FROM cells JOIN priors USING (grid_id)),
    w AS (SELECT station, lur, 1e0 / ((s.latitude - p.latitude) ** 2 + (s.longitude - p.longitude) ** 2) AS w FROM stations s, p) SELECT station, round(sum(w * lur) / sum(w), 5) AS value FROM w GROUP BY station""")
def idw_tree(spark, sf_dir: str) -> DataFrame:
    """The priors of all cells spread to the stations' places, far cells through the tree of boxes."""
    points = R.cells(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id").select(F.col("grid_id").alias("ord"), "latitude", "longitude", F.col("lur").alias("value"))
    places = station_points(spark, sf_dir).select("station", "latitude", "longitude")
    return rounded(spatial.idw(places, points, "station", limit=0).select("station", "value"), 5)


@query(roles("cells", "hourly") + f""", {STATIONS}, b AS (SELECT station, latitude, longitude, value - (SELECT avg(value) FROM stations) AS shift FROM stations),
    w AS (SELECT c.grid_id, b.shift, ((b.longitude - c.longitude) * 111e0 * cos(radians(lm))) ** 2 + ((b.latitude - c.latitude) * 111e0) ** 2 AS d2 FROM cells c, b, (SELECT avg(latitude) AS lm FROM b)) SELECT grid_id, round(sum(shift / d2) / sum(1 / d2), 6) AS shift FROM w GROUP BY grid_id""")
def idw_bias(spark, sf_dir: str) -> DataFrame:
    """Bias shifts of station anchors spread over the cells by distance in km; without anchors 0."""
    points = station_points(spark, sf_dir)
    points = points.crossJoin(F.broadcast(points.agg(F.avg("value").alias("m")))).select(F.col("station").alias("ord"), "latitude", "longitude", (F.col("value") - F.col("m")).alias("value"))
    return rounded(spatial.idw(R.cells(spark, sf_dir), points, "grid_id", exact=1e-6, km=111.0, default=0.0).select("grid_id", F.col("value").alias("shift")))


@query(roles("cells", "priors") + """, k AS (SELECT grid_id, latitude, longitude, atmo FROM cells JOIN priors USING (grid_id)), m AS (SELECT avg(atmo) AS m FROM k),
    p AS (SELECT a.grid_id, b.atmo AS v, sqrt((a.latitude - b.latitude) ** 2 + (a.longitude - b.longitude) ** 2) AS d, b.grid_id AS o FROM k a, k b WHERE a.atmo IS NULL AND b.atmo IS NOT NULL AND abs(a.latitude - b.latitude) < 0.01 AND abs(a.longitude - b.longitude) < 0.01),
    q AS (SELECT grid_id, round(min(d), 9) AS d, arg_min(v, (d, o)) AS v FROM p GROUP BY grid_id)
    SELECT k.grid_id, round(coalesce(atmo, m), 6) AS by_mean, round(coalesce(atmo, -1), 6) AS by_constant, round(coalesce(atmo, q.v), 6) AS by_nearest, q.d AS gap FROM k LEFT JOIN q USING (grid_id), m""")
def filled_prior(spark, sf_dir: str) -> DataFrame:
    """Gaps of the second prior filled by mean, by constant and by the nearest known cell, and the distance of that."""
    df = R.cells(spark, sf_dir).join(R.priors(spark, sf_dir), "grid_id").select("grid_id", "latitude", "longitude", "atmo")
    mean = spatial.fill_missing(df, "atmo", "mean").select("grid_id", F.col("atmo").alias("by_mean"))
    const = spatial.fill_missing(df, "atmo", "constant", -1.0).select("grid_id", F.col("atmo").alias("by_constant"))
    filled = spatial.fill_missing(df, "atmo", "nearest", size=(0.002, 0.002)).select("grid_id", F.col("atmo").alias("by_nearest"))
    near = spatial.nearest_join(df.filter("atmo is null").drop("atmo"), df.filter("atmo is not null"), (0.002, 0.002), [], id_col="grid_id").select("grid_id", F.round("distance", 9).alias("gap"))
    return rounded(mean.join(const, "grid_id").join(filled, "grid_id").join(near, "grid_id", "left"), gap=9)


@query(roles("raster") + """, q AS (SELECT row + 0.25e0 AS y, col + 0.5e0 AS x, (row * 50 + col)::BIGINT AS k FROM raster), a AS (SELECT k, x, y, floor(x)::INT + dx AS col, floor(y)::INT + dy AS row, (1 - abs(x - floor(x) - dx)) * (1 - abs(y - floor(y) - dy)) AS w FROM q, (VALUES (0), (1)) u(dx), (VALUES (0), (1)) v(dy))
    SELECT k, round(CASE WHEN count(value) = 4 THEN sum(w * value) END, 6) AS value FROM a LEFT JOIN raster USING (row, col) GROUP BY k""")
def bilinear(spark, sf_dir: str) -> DataFrame:
    r = R.raster(spark, sf_dir)
    points = r.select((F.col("row") * 50 + F.col("col")).cast("long").alias("k"), (F.col("row") + 0.25).alias("y"), (F.col("col") + 0.5).alias("x"))
    return rounded(spatial.bilinear_sample(points, r, "k", F.col("x"), F.col("y")))


#: A turned raster over the cells: longitude and latitude of pixel corners by column and row.
AFFINE = (0.0035, 0.0002, -6.4505, -0.0001, -0.0008, 53.2655)


@query(roles("cells", "raster") + """, p AS (SELECT grid_id, longitude + 6.4505e0 AS u, latitude - 53.2655e0 AS v, 0.0035e0 * -0.0008e0 - 0.0002e0 * -0.0001e0 AS s FROM cells),
    q AS (SELECT grid_id, (-0.0008e0 * u - 0.0002e0 * v) / s - 0.5e0 AS x, (0.0035e0 * v + 0.0001e0 * u) / s - 0.5e0 AS y FROM p),
    a AS (SELECT grid_id, floor(x)::INT + dx AS col, floor(y)::INT + dy AS row, (1 - abs(x - floor(x) - dx)) * (1 - abs(y - floor(y) - dy)) AS w FROM q, (VALUES (0), (1)) h(dx), (VALUES (0), (1)) k(dy))
    SELECT grid_id, round(CASE WHEN count(value) = 4 THEN sum(w * value) END, 4) AS value FROM a LEFT JOIN raster USING (row, col) GROUP BY grid_id""")
def affine_sampled(spark, sf_dir: str) -> DataFrame:
    """The raster at the cells' coordinates, placed by a turned affine."""
    x, y = spatial.raster_position(F.col("longitude"), F.col("latitude"), AFFINE)
    return rounded(spatial.bilinear_sample(R.cells(spark, sf_dir), R.raster(spark, sf_dir), "grid_id", x, y), 4)


@query(roles("raster") + """, c AS (SELECT row // 5 AS row, col // 5 AS col, value, row % 5 = 2 AND col % 5 = 2 AS mid FROM raster), f AS (SELECT row, col, value, count(*) AS n FROM c GROUP BY ALL)
    SELECT c.row, c.col, round(avg(value), 6) AS average, round(max(CASE WHEN mid THEN value END), 6) AS nearest, round(any_value(m), 6) AS mode FROM c JOIN (SELECT row, col, arg_max(value, (n, -value)) AS m FROM f GROUP BY row, col) g ON c.row = g.row AND c.col = g.col GROUP BY c.row, c.col""")
def resampled(spark, sf_dir: str) -> DataFrame:
    r = R.raster(spark, sf_dir)
    out = spatial.resample(r, 5).withColumnRenamed("value", "average")
    for method in ("nearest", "mode"):
        out = out.join(spatial.resample(r, 5, method).withColumnRenamed("value", method), ["row", "col"], "left")
    return rounded(out)


def _smooth_sql() -> str:
    import math

    w = {d: math.exp(-0.5 * (d / 0.6) ** 2) for d in range(-2, 3)}
    total = sum(w.values())
    offs = ", ".join(f"({a}, {b}, {w[a] / total * (w[b] / total)!r}e0)" if "e" not in repr(w[a] / total * (w[b] / total)) else f"({a}, {b}, {w[a] / total * (w[b] / total)!r})" for a in w for b in w)
    ref = lambda v, top: f"CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} > {top} THEN 2 * {top} + 1 - ({v}) ELSE {v} END"
    return f""", o(dr, dc, w) AS (VALUES {offs}), e AS (SELECT max(row) AS mr, max(col) AS mc FROM raster),
    a AS (SELECT row AS r0, col AS c0, {ref('row + dr', 'mr')} AS row, {ref('col + dc', 'mc')} AS col, w FROM raster, o, e)
    SELECT r0 AS row, c0 AS col, round(sum(w * value) / sum(w), 6) AS value FROM a JOIN raster USING (row, col) GROUP BY r0, c0"""


@query(roles("raster") + _smooth_sql())
def smoothed(spark, sf_dir: str) -> DataFrame:
    return rounded(spatial.gaussian_smooth(R.raster(spark, sf_dir)))


def _daily_smooth_sql() -> str:
    import math

    w = {d: math.exp(-0.5 * (d / 0.6) ** 2) for d in range(-2, 3)}
    offs = ", ".join(f"({a}, {b}, {w[a] * w[b]:.17e})" for a in w for b in w)
    ref = lambda v, top: f"CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} > {top} THEN 2 * {top} + 1 - ({v}) ELSE {v} END"
    return f""", o(dr, dc, w) AS (VALUES {offs}), e AS (SELECT max(row) AS mr, max(col) AS mc FROM raster),
    d AS (SELECT day, row, col, (row + col + day) % 7 <> 0 AS inside, CASE WHEN (row + col + day) % 7 <> 0 AND (row * 3 + col + day) % 5 <> 0 THEN value * (1 + day) END AS value FROM raster, range(3) t(day)),
    m AS (SELECT day, median(value) AS m FROM d GROUP BY day), f AS (SELECT day, row, col, coalesce(value, m) AS value FROM d JOIN m USING (day)),
    a AS (SELECT day, row AS r0, col AS c0, inside, {ref('row + dr', 'mr')} AS row, {ref('col + dc', 'mc')} AS col, w FROM d, o, e)
    SELECT day::INT AS day, r0 AS row, c0 AS col, round(CASE WHEN any_value(inside) THEN sum(w * value) / sum(w) END, 6) AS value FROM a JOIN f USING (day, row, col) GROUP BY day, r0, c0"""


@query(roles("raster") + _daily_smooth_sql())
def smoothed_days(spark, sf_dir: str) -> DataFrame:
    """Smoothing by day with gaps, within a support mask."""
    days = R.raster(spark, sf_dir).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(2))))
    place = lambda k: F.col("row") * k + F.col("col") + F.col("day")
    days = days.withColumn("inside", place(1) % 7 != 0).withColumn("value", F.when((place(1) % 7 != 0) & (place(3) % 5 != 0), F.col("value") * (1 + F.col("day"))))
    return rounded(spatial.gaussian_smooth(days, ["day"], support="inside").select("day", "row", "col", "value"))


@query(roles("raster") + """, q AS (SELECT row * 50 + col AS k, row + 0.3e0 AS y, col + 0.6e0 AS x FROM raster)
    SELECT k::BIGINT AS k, round(coalesce(value, -1e0), 6) AS value FROM q LEFT JOIN raster ON raster.row = round(y)::INT AND raster.col = round(x)::INT""")
def nearest_pixels(spark, sf_dir: str) -> DataFrame:
    """The pixel nearest to shifted positions, a default outside the raster."""
    r = R.raster(spark, sf_dir)
    points = r.select((F.col("row") * 50 + F.col("col")).cast("long").alias("k"), (F.col("row") + 0.3).alias("y"), (F.col("col") + 0.6).alias("x"))
    return rounded(spatial.nearest_sample(points, r, "k", F.col("x"), F.col("y"), -1.0).select("k", "value"))


@query(roles("cells", "hourly") + f""", {STATIONS}, m AS (SELECT station, latitude + 0.05e0 * (split_part(station, '_', 2)::INT % 3) AS latitude, longitude FROM stations),
    p AS (SELECT station, c.grid_id, c.r, sqrt((c.latitude - m.latitude) ** 2 + (c.longitude - m.longitude) ** 2) AS d FROM m, cells c)
    SELECT station, round(CASE WHEN min(d) <= 0.02e0 THEN arg_min(r, (d, grid_id)) ELSE -1 END::DOUBLE, 6) AS value FROM p GROUP BY station""")
def nearest_or_default(spark, sf_dir: str) -> DataFrame:
    """A value of the nearest cell, or a default for places far from every cell."""
    moved = station_points(spark, sf_dir).select("station", (F.col("latitude") + 0.05 * (F.split("station", "_")[1].cast("int") % 3)).alias("latitude"), "longitude")
    cells = R.cells(spark, sf_dir).withColumn("value", F.col("r").cast("double"))
    return rounded(spatial.nearest_join(moved, cells, (0.001, 0.0015), ["value"], most=0.02, default=-1.0).select("station", "value"))


@query(roles("cells") + """, q AS (SELECT DISTINCT r // 4 AS a, c // 15 AS b FROM cells), poly AS (SELECT a || '-' || b AS polygon_id, -6.45e0 + 0.0015e0 * (b * 15 - 0.5e0) AS x0, 53.25e0 + 0.001e0 * (a * 4 - 0.5e0) AS y0 FROM q)
    SELECT grid_id, polygon_id FROM cells LEFT JOIN poly ON longitude > x0 AND longitude < x0 + 0.0225e0 AND latitude > y0 AND latitude < y0 + 0.004e0""")
def polygon_of_cell(spark, sf_dir: str) -> DataFrame:
    """Cells assigned to rectangular districts by ray casting."""
    cells = R.cells(spark, sf_dir)
    q = cells.select(F.floor(F.col("r") / 4).alias("a"), F.floor(F.col("c") / 15).alias("b")).distinct()
    x0, y0 = -6.45 + 0.0015 * (F.col("b") * 15 - 0.5), 53.25 + 0.001 * (F.col("a") * 4 - 0.5)
    ring = F.array(F.array(x0, y0), F.array(x0 + 0.0225, y0), F.array(x0 + 0.0225, y0 + 0.004), F.array(x0, y0 + 0.004))
    polygons = q.select(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("polygon_id"), ring.alias("ring"))
    return covering.points_in_polygons(cells, polygons).select("grid_id", "polygon_id")


# Corners of a concave star around a hole, in units of the radius, and a triangle apart from it.
_STAR = ((1.0, 0.0), (0.35, 0.3), (0.0, 1.0), (-0.35, 0.3), (-1.0, 0.0), (-0.35, -0.3), (0.0, -1.0), (0.35, -0.3))
_HOLE = ((0.25, 0.0), (0.0, 0.2), (-0.25, 0.0), (0.0, -0.2))
_APART = ((1.1, 1.0), (1.9, 1.0), (1.1, 1.7))


def _edge_values() -> str:
    edges = [(*p, *q) for ring in (_STAR, _HOLE, _APART) for p, q in zip(ring, ring[1:] + ring[:1])]
    return ", ".join("(" + ", ".join(f"{v!r}e0" for v in e) + ")" for e in edges)


@query(roles("cells") + f""", p AS (SELECT s_suppkey AS polygon_id, -6.45e0 + 0.0015e0 * (s_suppkey * 37 % 120) AS x, 53.25e0 + 0.0001e0 * (s_suppkey * 53 % 250) AS y, 0.0004e0 * pow(2e0, s_suppkey % 9) AS r FROM supplier),
    u(a, b, c, d) AS (VALUES {_edge_values()}), e AS (SELECT polygon_id, x + r * a AS x1, y + r * b AS y1, x + r * c AS x2, y + r * d AS y2 FROM p, u),
    h AS (SELECT grid_id, polygon_id, count(*) AS n FROM cells JOIN e ON ((y1 > latitude) <> (y2 > latitude)) AND longitude < x1 + (latitude - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL)
    SELECT grid_id, min(polygon_id) AS polygon_id FROM cells LEFT JOIN (SELECT * FROM h WHERE n % 2 = 1) USING (grid_id) GROUP BY grid_id""")
def polygon_parts(spark, sf_dir: str) -> DataFrame:
    """Cells in districts around the suppliers' places: stars with a hole and a part of its own, radii from 40 m to 10 km."""
    k = F.col("s_suppkey")
    x, y, r = -6.45 + 0.0015 * (k * 37 % 120), 53.25 + 0.0001 * (k * 53 % 250), 0.0004 * F.pow(F.lit(2.0), k % 9)
    rings = F.array(*[F.array(*[F.array(x + r * a, y + r * b) for a, b in ring]) for ring in (_STAR, _HOLE, _APART)])
    districts = R.table(spark, sf_dir, "supplier").select(k.alias("polygon_id"), rings.alias("rings"))
    return covering.points_in_polygons(R.cells(spark, sf_dir), districts).select("grid_id", "polygon_id")


@query(roles("cells") + """, k AS (SELECT *, 0.0004e0 * (1 + r % 3) AS a, 0.0003e0 * (1 + c % 2) AS b FROM cells)
    SELECT grid_id, round(CASE c % 4 WHEN 0 THEN longitude + a / 3 WHEN 1 THEN longitude + a / 2 WHEN 2 THEN longitude + a ELSE longitude + 5 * a / 6 END, 8) AS longitude,
           round(CASE c % 4 WHEN 0 THEN latitude + b / 3 WHEN 1 THEN latitude + b / 2 WHEN 2 THEN latitude ELSE latitude + 5 * b / 6 END, 8) AS latitude FROM k""")
def centroids(spark, sf_dir: str) -> DataFrame:
    """Centroids of cell outlines of several shapes and sizes: triangles, boxes, flat lines (vertices' mean), angles."""
    x, y, c = F.col("longitude"), F.col("latitude"), F.col("c") % 4
    a, b = 0.0004 * (1 + F.col("r") % 3), 0.0003 * (1 + F.col("c") % 2)
    p = lambda i, j: F.array(x + i * a, y + j * b)
    ring = F.when(c == 0, F.array(p(0, 0), p(1, 0), p(0, 1))).when(c == 1, F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1)))
    ring = ring.when(c == 2, F.array(p(0, 0), p(1, 0), p(2, 0))).otherwise(F.array(p(0, 0), p(2, 0), p(2, 1), p(1, 1), p(1, 2), p(0, 2)))
    outlines = R.cells(spark, sf_dir).select("grid_id", ring.alias("ring"))
    return rounded(tables.with_centroid(outlines).select("grid_id", "longitude", "latitude"), 8)


@query(roles("cells") + ", a AS (SELECT DISTINCT latitude FROM cells), b AS (SELECT DISTINCT longitude FROM cells) SELECT round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, 0.001e0 AS d_latitude, 0.0015e0 AS d_longitude FROM a, b")
def value_grid(spark, sf_dir: str) -> DataFrame:
    return rounded(spatial.grid_from_values(R.cells(spark, sf_dir)), 9)


@query(roles("cells") + """, b AS (SELECT min(latitude) AS s, max(latitude) AS n, min(longitude) AS w, max(longitude) AS e FROM cells),
    p AS (SELECT *, 300 / 111320e0 AS dl, 300 / (111320e0 * cos(radians((s + n) / 2))) AS dn FROM b), q AS (SELECT *, ceil((n - s) / dl)::BIGINT AS ni, ceil((e - w) / dn)::BIGINT AS nj FROM p)
    SELECT k, (k // nj)::INT AS grid_i, (k % nj)::INT AS grid_j, round(s + (k // nj) * dl, 9) AS latitude, round(w + (k % nj) * dn, 9) AS longitude FROM q, LATERAL (SELECT unnest(range(ni * nj)) AS k)""")
def analysis_grid(spark, sf_dir: str) -> DataFrame:
    """A regular grid of 300 m over the cells' bounds."""
    b = R.cells(spark, sf_dir).agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    return rounded(spatial.grid_from_bounds(spark, *b, 300.0), 9)


@query(roles("cells") + ", t AS (SELECT DISTINCT ts::DATE AS date FROM events) SELECT date, count(*) AS n, round(sum(latitude), 4) AS total FROM cells, t GROUP BY date", date="date")
def space_time_frame(spark, sf_dir: str) -> DataFrame:
    times = R.table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    return rounded(spatial.space_time_frame(R.cells(spark, sf_dir), times).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("latitude").alias("total")), 4)


@query(roles("cells", "daily") + """, k AS (SELECT grid_id, round_even(latitude, 2) AS la, round_even(longitude, 2) AS lo FROM cells), d AS (SELECT la, lo, date, avg(station) AS station FROM daily JOIN k USING (grid_id) GROUP BY ALL)
    SELECT round(la, 6) AS la, round(lo, 6) AS lo, date, round(station, 6) AS station FROM d WHERE station IS NOT NULL""", date="date")
def rounded_coordinates(spark, sf_dir: str) -> DataFrame:
    """Join and mean on rounded coordinates."""
    keys = R.cells(spark, sf_dir).select("grid_id", scalars.round_even(F.col("latitude"), 2).alias("la"), scalars.round_even(F.col("longitude"), 2).alias("lo"))
    df = daily_sparse(spark, sf_dir).join(keys, "grid_id").groupBy("la", "lo", "date").agg(F.avg("station").alias("station"))
    return rounded(df.filter("station is not null"))


@query(roles("cells") + """, b AS (SELECT grid_id, sqrt((latitude - 53.25e0) ** 2 + (longitude + 6.45e0) ** 2) / 0.05e0 AS d FROM cells)
    SELECT grid_id, round(exp(-d), 6) AS matern12, round((1 + sqrt(3e0) * d) * exp(-sqrt(3e0) * d), 6) AS matern32, round((1 + sqrt(5e0) * d + 5e0 / 3e0 * d * d) * exp(-sqrt(5e0) * d), 6) AS matern52, round(exp(-0.5e0 * d * d), 6) AS rbf FROM b""")
def kernels(spark, sf_dir: str) -> DataFrame:
    """Kernel values of every cell to one point."""
    pairs = [(F.col("latitude"), F.lit(53.25)), (F.col("longitude"), F.lit(-6.45))]
    return rounded(R.cells(spark, sf_dir).select("grid_id", *[scalars.kernel(k, pairs, [0.05, 0.05]).alias(k) for k in scalars.KERNELS]))
