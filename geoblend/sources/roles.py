"""The test tables in the roles of the library: cells, hourly readings, priors, predictions, rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numerics import hash_unit
from ..functions.scalars import grid_id

#: Event types of the hourly sources.
KINDS = {"station": "purchase", "satellite": "view", "traffic": "click"}
WIDTH = 120
#: Degrees of latitude a row and of longitude a column of the cells.
STEP = (0.001, 0.0015)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_col(key):
    return F.floor(key / WIDTH).cast("int"), F.pmod(key, F.lit(WIDTH)).cast("int")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_id, r, c, latitude, longitude."""
    r, c = _row_col(F.col("c_custkey"))
    base = table(spark, sf_dir, "customer").select("c_custkey", r.alias("r"), c.alias("c"))
    return base.select(grid_id(F.col("r"), F.col("c")).alias("grid_id"), "r", "c", (53.25 + 0.001 * F.col("r")).alias("latitude"), (-6.45 + 0.0015 * F.col("c")).alias("longitude"))


def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_id, lur, atmo (every seventh cell null)."""
    r, c = _row_col(F.col("c_custkey"))
    value = F.col("c_acctbal") / 100.0
    return table(spark, sf_dir, "customer").select(grid_id(r, c).alias("grid_id"), value.alias("lur"), F.when(F.col("c_custkey") % 7 != 0, value * 0.9 + 2.0).alias("atmo"))


def hourly(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """grid_id, ts, value of one hourly source."""
    r, c = _row_col(F.col("user_id") * 10)
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == KINDS[kind])
    return rows.select(grid_id(r, c).alias("grid_id"), "ts", "value")


def wind_columns() -> list[Column]:
    """freq_k, speed_k of a row's grid_id and date, for eight sectors."""
    freq = [hash_unit(f"f{k}", "grid_id", "date").alias(f"freq_{k}") for k in range(8)]
    return freq + [(10.0 * hash_unit(f"s{k}", "grid_id", "date")).alias(f"speed_{k}") for k in range(8)]


def wind(days: DataFrame) -> DataFrame:
    """grid_id, date, freq_k, speed_k for eight sectors of each (grid_id, date) row."""
    return days.select("grid_id", "date", *wind_columns())


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, station (supplier), day, y, mean, std, baseline of the scored table."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_returnflag").alias("source"),
        F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("y"),
        (25.0 + 100.0 * (F.col("l_discount") - 0.05)).alias("mean"), (5.0 + 100.0 * F.col("l_tax")).alias("std"), (F.col("l_extendedprice") / 1500.0).alias("baseline"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, value: 50 columns wide."""
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), F.pmod("p_partkey", F.lit(50)).cast("int").alias("col"), F.col("p_retailprice").alias("value"))
