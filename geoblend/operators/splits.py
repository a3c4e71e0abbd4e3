"""Train, validation and test splits and folds. A strategy is any function that adds fold or split columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import global_rank, hash_unit


def random_split(df: DataFrame, keys: list[str], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Adds split by the hash of the row's key: sizes follow the ratios (normalised to 1) up to chance, with no shuffle."""
    total = sum(ratios)
    a, b = ratios[0] / total, (ratios[0] + ratios[1]) / total
    h = hash_unit(seed, *keys)
    return df.withColumn("split", F.when(h < a, "train").when(h < b, "val").otherwise("test"))


def exact_split(df: DataFrame, keys: list[str], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """As random_split with exact sizes: the hash order's global rank is cut."""
    total = sum(ratios)
    n = df.count()
    n_train, n_val = int(n * ratios[0] / total), int(n * ratios[1] / total)
    ranked = global_rank(df.withColumn("_h", hash_unit(seed, *keys)), ["_h", *keys], "_rank")
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_rank")


def ranked_keys(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys (cells, stations, days) with their 0-based place in hash order and their number."""
    keys = df.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_h", hash_unit(seed, key))
    ranked = global_rank(keys, ["_h", key], "_rank")
    n = ranked.agg(F.count(F.lit(1)).alias("n_keys"))
    return ranked.select(key, (F.col("_rank") - 1).alias("place")).crossJoin(F.broadcast(n))


def spatial_split(df: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, cell: str = "grid_id") -> DataFrame:
    """Whole cells go to one split: int(n * ratio) cells to train and val, the rest to test."""
    total = sum(ratios)
    keys = ranked_keys(df, cell, seed)
    n_train = F.floor(F.col("n_keys") * (ratios[0] / total))
    n_val = F.floor(F.col("n_keys") * (ratios[1] / total))
    split = F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_val, "val").otherwise("test")
    return df.join(keys.select(cell, split.alias("split")), cell)


def holdout_cells(df: DataFrame, source: str, fraction: float = 0.2, seed: int = 42, cell: str = "grid_id", rounded: bool = False) -> DataFrame:
    """Held-out cells among those with the source: max(1, int or round of n * fraction), and always fewer than all."""
    keys = ranked_keys(df.filter(F.col(source).isNotNull()), cell, seed)
    share = F.col("n_keys") * fraction
    many = F.greatest(F.bround(share, 0) if rounded else F.floor(share), F.lit(1))
    return keys.filter(F.col("place") < F.least(many, F.col("n_keys") - 1)).select(cell)


def missing_cells(df: DataFrame, source: str, wanted: DataFrame, cell: str = "grid_id") -> DataFrame:
    """Wanted held-out cells that have no value of the source: an error for the caller to raise."""
    return wanted.select(cell).distinct().join(df.filter(F.col(source).isNotNull()).select(cell), cell, "left_anti")


def station_split(df: DataFrame, source: str, test: float = 0.2, val: float = 0.15, seed: int = 42, cell: str = "grid_id", keys: tuple[str, ...] = ("grid_id", "date"), held: DataFrame | None = None) -> DataFrame:
    """All rows of held-out stations are test; the others split into train and val by hash."""
    held = held if held is not None else holdout_cells(df, source, test, seed, cell, rounded=True)
    out = df.join(held.select(cell).withColumn("_t", F.lit(True)), cell, "left")
    rest = F.when(hash_unit(seed + 1, *keys) < val, "val").otherwise("train")
    return out.withColumn("split", F.when(F.col("_t"), "test").otherwise(rest)).drop("_t")


def temporal_rank(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds n_before (rows at earlier times), n_at (rows at this time), n_all: counts on the small table of times."""
    times = df.groupBy(ts).agg(F.count(F.lit(1)).alias("n_at"))
    w = Window.orderBy(ts)
    times = times.withColumn("n_before", F.sum("n_at").over(w) - F.col("n_at")).withColumn("n_all", F.sum("n_at").over(Window.partitionBy()))
    return df.join(times, ts)


def temporal_split(df: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), ts: str = "ts") -> DataFrame:
    """Split by time order; rows of one time stay together (in the split where that time begins)."""
    total = sum(ratios)
    share = F.col("n_before") / F.col("n_all")
    split = F.when(share < ratios[0] / total, "train").when(share < (ratios[0] + ratios[1]) / total, "val").otherwise("test")
    return temporal_rank(df, ts).withColumn("split", split).drop("n_at", "n_before", "n_all")


def random_folds(df: DataFrame, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1: contiguous parts of the hash order, the first n mod k of them one row larger."""
    ranked = global_rank(df.withColumn("_h", hash_unit(seed, *keys)), ["_h", *keys], "_rank")
    return ranked.withColumn("fold", even_part(F.col("_rank") - 1, F.lit(df.count()), k)).drop("_h", "_rank")


def spatial_folds(df: DataFrame, k: int = 5, seed: int = 42, cell: str = "grid_id") -> DataFrame:
    """Adds fold: the k-means cluster of the cell's mean coordinates. Distinct cells are clustered, not rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    means = df.groupBy(cell).agg(F.avg("latitude").alias("_lat"), F.avg("longitude").alias("_lon")).orderBy(cell)
    points = VectorAssembler(inputCols=["_lat", "_lon"], outputCol="features").transform(means)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="fold").fit(points)
    return df.join(model.transform(points).select(cell, "fold"), cell)


def temporal_folds(df: DataFrame, k: int = 5, mode: str = "block", ts: str = "ts") -> DataFrame:
    """block: adds fold by time order. forward: long form with role; fold f tests on block f + 1 and trains on blocks up to f."""
    block = F.least(F.floor(F.col("n_before") * k / F.col("n_all")), F.lit(k - 1)).cast("int")
    blocked = temporal_rank(df, ts).withColumn("block", block).drop("n_at", "n_before", "n_all")
    if mode == "block":
        return blocked.withColumnRenamed("block", "fold")
    folds = F.sequence(F.greatest(F.col("block") - 1, F.lit(0)), F.lit(k - 2))
    out = blocked.withColumn("fold", F.explode(folds))
    return out.withColumn("role", F.when(F.col("block") == F.col("fold") + 1, "test").otherwise("train")).filter((F.col("block") <= F.col("fold") + 1)).drop("block")


def space_time_folds(df: DataFrame, k_space: int = 3, k_time: int = 3, seed: int = 42, ts: str = "ts") -> DataFrame:
    """Adds fold = cluster * k_time + time block (equal numbers of distinct times); empty folds do not appear."""
    spatial = spatial_folds(df, k_space, seed).withColumnRenamed("fold", "cluster")
    times = spatial.select(ts).distinct()
    place = F.row_number().over(Window.orderBy(ts)) - 1
    size = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / k_time), F.lit(1))
    times = times.select(ts, F.least(F.floor(place / size), F.lit(k_time - 1)).cast("int").alias("block"))
    return spatial.join(times, ts).withColumn("fold", F.col("cluster") * k_time + F.col("block")).drop("cluster", "block")


def even_part(place, n, k: int):
    """Part of k nearly equal contiguous parts; the first n mod k parts have one more."""
    q, r = F.floor(n / k), n % k
    return F.when(place < r * (q + 1), F.floor(place / (q + 1))).otherwise(r + F.floor((place - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")


def station_date_folds(df: DataFrame, source: str, k_station: int = 3, k_date: int = 3, seed: int = 42, cell: str = "grid_id", date: str = "date") -> DataFrame:
    """fold of rows with the source: station part (hash order) * k_date + contiguous date part."""
    rows = df.filter(F.col(source).isNotNull())
    stations = ranked_keys(rows, cell, seed).select(cell, even_part(F.col("place"), F.col("n_keys"), k_station).alias("_s"))
    dates = rows.select(date).distinct()
    place, n = F.row_number().over(Window.orderBy(date)) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    dates = dates.select(date, place.alias("_p"), n.alias("_n")).select(date, even_part(F.col("_p"), F.col("_n"), k_date).alias("_d"))
    return rows.join(stations, cell).join(dates, date).withColumn("fold", F.col("_s") * k_date + F.col("_d")).drop("_s", "_d")


def leave_one_station_out(df: DataFrame, source: str, cell: str = "grid_id", limit: int = 10_000) -> DataFrame:
    """One fold per station, in long form: fold (station), role; each row once per fold, so it grows with rows x stations.
    For sums by fold use left_out_means, which does not. The station list is broadcast behind a count."""
    stations = df.filter(F.col(source).isNotNull()).select(F.col(cell).alias("fold")).distinct()
    stations = F.broadcast(stations) if stations.count() <= limit else stations
    return df.crossJoin(stations).withColumn("role", F.when(F.col(cell) == F.col("fold"), "test").otherwise("train"))


def left_out_means(df: DataFrame, source: str, cell: str = "grid_id") -> DataFrame:
    """fold (station), n, n_test, train_mean of the source: each station's own count and sum taken from the total."""
    rows = df.filter(F.col(source).isNotNull())
    own = rows.groupBy(F.col(cell).alias("fold")).agg(F.count(F.lit(1)).alias("n_test"), F.sum(source).alias("_s"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(source).alias("_t"))
    out = own.crossJoin(F.broadcast(total))
    return out.select("fold", "n", "n_test", F.try_divide(F.col("_t") - F.col("_s"), F.col("n") - F.col("n_test")).alias("train_mean"))
