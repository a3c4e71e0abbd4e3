"""Reading, checking and writing source tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Source:
    """A registered source: its column in the wide table, noise and linear link."""

    name: str
    column: str
    noise: float = 1.0
    slope: float = 1.0
    intercept: float = 0.0


@dataclass(frozen=True)
class Mapping:
    """Logical to physical names of a wide source table."""

    keys: dict[str, str] = field(default_factory=lambda: {"grid_id": "grid_id", "latitude": "latitude", "longitude": "longitude", "ts": "timestamp"})
    sources: dict[str, str] = field(default_factory=lambda: {"station": "epa_no2", "satellite": "satellite_values", "low_cost": "low_cost_data"})
    covariates: tuple[str, ...] = ()


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def map_source(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Renamed and checked wide table; a source that the table lacks becomes a null column."""
    require_columns(df, [*mapping.keys.values(), *mapping.covariates])
    have = {s: c for s, c in mapping.sources.items() if c in df.columns}
    if not have:
        raise ValueError(f"no observation column of {sorted(mapping.sources.values())}")
    keys = [F.col(c).alias(k) for k, c in mapping.keys.items()]
    values = [finite(have[s]).alias(s) if s in have else F.lit(None).cast("double").alias(s) for s in mapping.sources]
    return df.select(*keys, *values, *[finite(c).alias(c) for c in mapping.covariates])


def finite(column: str):
    """double or null: unreadable, NaN and infinite values are null."""
    v = F.expr(f"try_cast(`{column}` AS double)")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def drop_invalid_keys(df: DataFrame, lat: str = "latitude", lon: str = "longitude", ts: str = "ts") -> DataFrame:
    """Rows with finite coordinates and a readable time, coerced."""
    out = df.withColumn(lat, finite(lat)).withColumn(lon, finite(lon)).withColumn(ts, F.try_to_timestamp(F.col(ts).cast("string")))
    return out.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(ts).isNotNull())


def dropped_counts(df: DataFrame, lat: str = "latitude", lon: str = "longitude", ts: str = "ts") -> DataFrame:
    """One row: rows, rows without a finite place, rows without a readable time, rows that drop_invalid_keys() drops."""
    place = finite(lat).isNull() | finite(lon).isNull()
    time = F.try_to_timestamp(F.col(ts).cast("string")).isNull()
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(place).alias("n_no_place"), F.count_if(time).alias("n_no_time"), F.count_if(place | time).alias("n_dropped"))


def validation_report(df: DataFrame, sources: list[str]) -> DataFrame:
    """One row: coordinate bounds, valid counts and whether the table may be used."""
    valid = sum((F.col(s).isNotNull().cast("int") for s in sources), F.lit(0))
    out = df.agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        F.count_if(valid > 0).alias("n_valid"),
    )
    good = (F.col("min_lat") >= -90) & (F.col("max_lat") <= 90) & (F.col("min_lon") >= -180) & (F.col("max_lon") <= 180) & (F.col("n_valid") > 0)
    return out.withColumn("ok", F.coalesce(good, F.lit(False)))


def summary(df: DataFrame, sources: list[str], approximate: bool = False) -> DataFrame:
    """One row per source: rows, distinct cells and times, valid count and percent."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), distinct("grid_id").alias("n_cells"), distinct("ts").alias("n_times"), *[F.count(s).alias(s) for s in sources])
    out = totals.unpivot(["n_rows", "n_cells", "n_times"], sources, "source", "n_valid")
    return out.withColumn("pct_valid", F.when(F.col("n_rows") > 0, 100.0 * F.col("n_valid") / F.col("n_rows")))


# --- cell geometry from GeoJSON ------------------------------------------------------------------------------------

GEOJSON = "features array<struct<properties:struct<grid_id:string>,geometry:struct<type:string,coordinates:string>>>"


def read_geojson_cells(spark: SparkSession, path: str) -> DataFrame:
    """grid_id, ring (the first outer ring, an array of [lon, lat]), rings (those of all parts, holes included) of Polygon and
    MultiPolygon features; other features have nulls."""
    features = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind = F.col("f.geometry.type")
    parts = F.when(kind == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(kind == "MultiPolygon", F.flatten(parts)).when(kind == "Polygon", F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    return features.select(F.trim("f.properties.grid_id").alias("grid_id"), F.try_element_at(rings, F.lit(1)).alias("ring"), rings.alias("rings"))


def with_centroid(cells: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds longitude, latitude: the area-weighted centroid, or the vertices' mean for flat or short rings.

    Areas are taken from the ring's first vertex: far from the origin, small rings would lose all digits.
    """
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    local = F.transform(ring, lambda p: F.struct((p[0] - F.col(ring)[0][0]).alias("x"), (p[1] - F.col(ring)[0][1]).alias("y")))
    out = cells.withColumn("_local", local)
    nxt = F.concat(F.slice("_local", F.lit(2), F.size("_local") - 1), F.slice("_local", F.lit(1), F.lit(1)))
    edges = F.zip_with("_local", nxt, lambda p, q: F.struct((p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y"), (p["x"] * q["y"] - q["x"] * p["y"]).alias("c")))
    out = out.withColumn("_edges", F.when(F.size("_local") > 0, edges))
    total = lambda f: F.aggregate("_edges", F.lit(0.0), lambda s, e: s + f(e))
    out = out.withColumn("_area", total(lambda e: e["c"]) / 2)
    flat = (F.size(ring) < 3) | (F.abs("_area") < 1e-12)
    centre = lambda k, axis: F.when(flat, mean(k)).otherwise(F.col(ring)[0][k] + total(lambda e: e[axis] * e["c"]) / (6 * F.col("_area")))
    return out.withColumn("longitude", centre(0, "x")).withColumn("latitude", centre(1, "y")).drop("_local", "_edges", "_area")


# --- sinks -----------------------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """Where tables between steps are written: below spark.checkpoint.dir; an own folder only where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/geoblend-shared"
    return f"{base.rstrip('/')}/geoblend"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir; an own one only where that is unset) and
    read back: for tables used several times, and to cut lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys to four tasks a core: for steps that compute for long over few bytes, by which Spark would join
    partitions to a few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, resume: bool = False) -> bool:
    """Write, partitioned by columns if given; with resume an existing finished output is left alone (returns False)."""
    if resume and path_exists(df.sparkSession, f"{path.rstrip('/')}/_SUCCESS"):
        return False
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)
    return True
