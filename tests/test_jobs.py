import numpy as np
from pyspark.sql import functions as F

from geoblend.operators import field
from geoblend.plans import jobs
from geoblend.sources.tables import Source


def readings(spark, n, scale):
    return spark.range(n).select(F.concat(F.lit(" c"), (F.col("id") % 12).cast("string")).alias("grid_id"), F.timestamp_seconds(1704067200 + F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), (scale * (1 + F.col("id") % 5)).alias("value"))


def test_daily_job_is_restartable(spark, tmp_path):
    cells = spark.createDataFrame([(f"c{i}", 53 + i / 100, -6 + i / 100) for i in range(12)], "grid_id string, latitude double, longitude double")
    priors = spark.createDataFrame([(f"c{i}", 10.0, None if i % 2 else 12.0) for i in range(12)], "grid_id string, lur double, atmo double")
    src = {"station": readings(spark, 240, 3.0), "satellite": readings(spark, 240, 2.0)}
    path = str(tmp_path / "daily")
    a = jobs.run_daily(spark, src, cells, priors, path, jobs.DailyJob(hours=(0, 23)))
    n = a.count()
    b = jobs.run_daily(spark, {}, cells, priors, path)
    assert n == b.count() > 0 and a.filter("prior is null").count() == 0
    dense = jobs.build_daily(src, cells, priors, jobs.DailyJob(dense=True))
    assert dense.count() == 12 * src["station"].select(F.to_date("ts")).distinct().count()


def test_fit_score_and_maps(spark, tmp_path):
    rng = np.random.default_rng(3)
    pts = rng.random((20, 2))
    rows = [(f"c{i}", d, float(x), float(y), d / 5, "station", float(np.sin(3 * x) + 0.05 * rng.normal()), 0.0) for i, (x, y) in enumerate(pts) for d in range(5)]
    df = spark.createDataFrame(rows, "grid_id string, day int, x double, y double, t double, source string, value double, prior double")
    source = [Source("station", "station", 0.1)]
    tested, scores = jobs.fit_and_score(df, source, "station", 12, 2)
    assert tested.select("grid_id").distinct().count() == 4 and scores.first()["rmse"] < 0.4
    grid = df.select("grid_id", "x", "y", "prior").distinct()
    maps = jobs.sequential_maps(field.with_source(df, source), grid, [0, 1, 2, 3, 4, 7], str(tmp_path / "maps"), 12)
    assert maps.count() == 20 * 6 and maps.filter("std <= 0 or mean is null").count() == 0
    assert maps.filter("day = 7").agg(F.max("n_obs")).first()[0] == 0
