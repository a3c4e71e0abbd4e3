"""Queries of splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splits
from ..sources import roles as R
from .etl import daily_sparse
from .registry import hash_sql, query, roles, rounded

ROWS = "st AS (SELECT grid_id, date, station FROM daily WHERE station IS NOT NULL)"


def station_rows(spark, sf_dir: str) -> DataFrame:
    return daily_sparse(spark, sf_dir).filter("station is not null").select("grid_id", "date", "station")


_H = hash_sql(42, "id")


@query(roles("predictions") + f", h AS (SELECT id, {_H} AS h FROM predictions) SELECT id, CASE WHEN h < 0.7e0 THEN 'train' WHEN h < 0.85e0 THEN 'val' ELSE 'test' END AS split FROM h")
def random_split(spark, sf_dir: str) -> DataFrame:
    return splits.random_split(R.predictions(spark, sf_dir).select("id"), ["id"])


@query(roles("predictions") + f""", h AS (SELECT id, row_number() OVER (ORDER BY {_H}, id) AS k, count(*) OVER () AS n FROM predictions)
    SELECT id, CASE WHEN k <= trunc(n * 0.7e0) THEN 'train' WHEN k <= trunc(n * 0.7e0) + trunc(n * 0.15e0) THEN 'val' ELSE 'test' END AS split FROM h""")
def exact_split(spark, sf_dir: str) -> DataFrame:
    return splits.exact_split(R.predictions(spark, sf_dir).select("id"), ["id"])


def _keys(table: str, key: str, seed: int) -> str:
    return f"(SELECT {key}, row_number() OVER (ORDER BY {hash_sql(seed, key)}, {key}) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table}))"


@query(roles("daily") + f""", {ROWS}, k AS {_keys('st', 'grid_id', 42)} SELECT grid_id, date, CASE WHEN p < floor(n * 0.7e0) THEN 'train' WHEN p < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END AS split FROM st JOIN k USING (grid_id)""", date="date")
def spatial_split(spark, sf_dir: str) -> DataFrame:
    return splits.spatial_split(station_rows(spark, sf_dir)).select("grid_id", "date", "split")


@query(roles("daily") + f""", {ROWS}, k AS {_keys('st', 'grid_id', 42)}, h AS (SELECT grid_id FROM k WHERE p < least(greatest(round_even(n * 0.2e0, 0), 1), n - 1))
    SELECT grid_id, date, CASE WHEN h.grid_id IS NOT NULL THEN 'test' WHEN {hash_sql(43, "grid_id", "date")} < 0.15e0 THEN 'val' ELSE 'train' END AS split FROM st LEFT JOIN h USING (grid_id)""", date="date")
def station_holdout(spark, sf_dir: str) -> DataFrame:
    return splits.station_split(station_rows(spark, sf_dir), "station").select("grid_id", "date", "split")


@query(roles("daily", "cells") + f""", {ROWS} SELECT c.grid_id FROM cells c ANTI JOIN st USING (grid_id)""")
def missing_holdouts(spark, sf_dir: str) -> DataFrame:
    """Cells that cannot be held out, as no station reports there."""
    return splits.missing_cells(daily_sparse(spark, sf_dir), "station", R.cells(spark, sf_dir))


@query(roles("predictions") + """, t AS (SELECT day, count(*) AS c FROM predictions GROUP BY day), w AS (SELECT day, (sum(c) OVER (ORDER BY day) - c) / sum(c) OVER ()::DOUBLE AS s FROM t)
    SELECT id, CASE WHEN s < 0.7e0 THEN 'train' WHEN s < 0.85e0 THEN 'val' ELSE 'test' END AS split FROM predictions JOIN w USING (day)""")
def temporal_split(spark, sf_dir: str) -> DataFrame:
    return splits.temporal_split(R.predictions(spark, sf_dir).select("id", "day"), ts="day").select("id", "split")


@query(roles("predictions") + f", h AS (SELECT id, row_number() OVER (ORDER BY {_H}, id) - 1 AS p, count(*) OVER () AS n FROM predictions) SELECT id, CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END::INT AS fold FROM h")
def random_folds(spark, sf_dir: str) -> DataFrame:
    return splits.random_folds(R.predictions(spark, sf_dir).select("id"), ["id"])


_BLOCK = """t AS (SELECT day, count(*) AS c FROM predictions GROUP BY day), w AS (SELECT day, least(floor((sum(c) OVER (ORDER BY day) - c) * 5 / sum(c) OVER ()::DOUBLE), 4)::INT AS b FROM t)"""


@query(roles("predictions") + f", {_BLOCK} SELECT id, b AS fold FROM predictions JOIN w USING (day)")
def temporal_folds(spark, sf_dir: str) -> DataFrame:
    return splits.temporal_folds(R.predictions(spark, sf_dir).select("id", "day"), ts="day").select("id", "fold")


@query(roles("predictions") + f", {_BLOCK}, f AS (SELECT i::INT AS fold FROM range(4) r(i)) SELECT id, fold, CASE WHEN b = fold + 1 THEN 'test' ELSE 'train' END AS role FROM predictions JOIN w USING (day) JOIN f ON b <= fold + 1")
def forward_folds(spark, sf_dir: str) -> DataFrame:
    return splits.temporal_folds(R.predictions(spark, sf_dir).select("id", "day"), mode="forward", ts="day").select("id", "fold", "role")


def _part(p: str, n: str, k: int) -> str:
    return f"(CASE WHEN {p} < ({n} % {k}) * ({n} // {k} + 1) THEN {p} // ({n} // {k} + 1) ELSE {n} % {k} + ({p} - ({n} % {k}) * ({n} // {k} + 1)) // greatest({n} // {k}, 1) END)"


@query(roles("daily") + f""", {ROWS}, k AS {_keys('st', 'grid_id', 42)}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS dp, count(*) OVER () AS dn FROM (SELECT DISTINCT date FROM st))
    SELECT grid_id, date, ({_part('p', 'n', 3)} * 3 + {_part('dp', 'dn', 3)})::INT AS fold FROM st JOIN k USING (grid_id) JOIN d USING (date)""", date="date")
def station_date_folds(spark, sf_dir: str) -> DataFrame:
    return splits.station_date_folds(station_rows(spark, sf_dir), "station").select("grid_id", "date", "fold")


@query(roles("daily") + f""", {ROWS}, f AS (SELECT DISTINCT grid_id AS fold FROM st) SELECT fold, count(*) AS n, count(*) FILTER (grid_id = fold) AS n_test, round(avg(CASE WHEN grid_id <> fold THEN station END), 6) AS train_mean FROM st, f GROUP BY fold""")
def leave_one_station_out(spark, sf_dir: str) -> DataFrame:
    return rounded(splits.left_out_means(station_rows(spark, sf_dir), "station"))


@query(date="date")
def spatial_folds(spark, sf_dir: str) -> DataFrame:
    """Folds by k-means of cell coordinates."""
    df = station_rows(spark, sf_dir).join(R.cells(spark, sf_dir), "grid_id")
    return splits.spatial_folds(df, 4).select("grid_id", "date", "fold")


@query(date="date")
def space_time_folds(spark, sf_dir: str) -> DataFrame:
    df = station_rows(spark, sf_dir).join(R.cells(spark, sf_dir), "grid_id").withColumn("ts", F.col("date"))
    return splits.space_time_folds(df).select("grid_id", "date", "fold")
