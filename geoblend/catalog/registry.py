"""Registration of queries, and the SQL of the roles of the test tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_ROLES = {
    "cells": """SELECT concat_ws('_', c_custkey // 120, c_custkey % 120) AS grid_id, (c_custkey // 120)::INT AS r, (c_custkey % 120)::INT AS c,
        53.25e0 + 0.001e0 * (c_custkey // 120) AS latitude, -6.45e0 + 0.0015e0 * (c_custkey % 120) AS longitude FROM customer""",
    "priors": """SELECT concat_ws('_', c_custkey // 120, c_custkey % 120) AS grid_id, c_acctbal / 100e0 AS lur,
        CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 100e0 * 0.9e0 + 2e0 END AS atmo FROM customer""",
    "hourly": """SELECT concat_ws('_', user_id * 10 // 120, user_id * 10 % 120) AS grid_id, ts, value,
        CASE event_type WHEN 'purchase' THEN 'station' WHEN 'view' THEN 'satellite' WHEN 'click' THEN 'traffic' END AS kind FROM events""",
    "daily": """SELECT grid_id, ts::DATE AS date, avg(CASE WHEN kind = 'station' THEN value END) AS station,
        avg(CASE WHEN kind = 'satellite' THEN value END) AS satellite, avg(CASE WHEN kind = 'traffic' THEN value END) AS traffic
        FROM hourly WHERE kind IS NOT NULL GROUP BY ALL""",
    "predictions": """SELECT l_orderkey || '_' || l_linenumber AS id, l_returnflag AS source, l_suppkey AS station, l_shipdate::DATE AS day,
        l_quantity AS y, 25e0 + 100e0 * (l_discount - 0.05e0) AS mean, 5e0 + 100e0 * l_tax AS std, l_extendedprice / 1500e0 AS baseline FROM lineitem""",
    "raster": """SELECT (p_partkey // 50)::INT AS row, (p_partkey % 50)::INT AS col, p_retailprice AS value FROM part""",
}
_NEEDS = {"daily": ("hourly",)}


def roles(*names: str) -> str:
    """WITH clause of the roles (and those they need)."""
    wanted: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in wanted:
                wanted.append(x)
    return "WITH " + ", ".join(f"{n} AS ({_ROLES[n]})" for n in wanted)


def hash_sql(seed: int | str, *keys: str) -> str:
    """hash_unit() in SQL."""
    text = "concat_ws('|', " + ", ".join(f"coalesce(({k})::VARCHAR, '')" for k in keys) + f", '{seed}')"
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT / 4294967296e0)"


def query(sql: str | None = None, date: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL. A date column is given as text on both sides."""

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumn(date, df[date].cast("string")) if date else df

        QUERIES[f.__name__] = functools.wraps(f)(run)
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({date}::VARCHAR AS {date}) FROM ({sql})" if date else sql
        return f

    return add


def rounded(df, digits: int = 6, **own: int):
    """Doubles rounded, as sums differ in the last digits between engines; no negative zeros."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(c, own.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
