import math
import random

from pyspark.sql import functions as F

from geoblend.functions.numerics import global_rank, hash_unit, norm_cdf, z_of
from geoblend.functions.scalars import KERNELS, bearing, no2_class, sector_of


def test_norm_cdf_matches_erfc(spark):
    zs = [-9.0, -5.0, -1.3, -0.2, 0.0, 0.4, 0.66, 1.0, 2.5, 5.9, 8.5]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", norm_cdf("z").alias("p")).collect()
    for r in rows:
        assert math.isclose(r["p"], 0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel_tol=1e-12)


def test_z_of():
    assert abs(z_of(0.95) - 1.959964) < 1e-5


def test_hash_unit_is_stable_and_uniform(spark):
    h = hash_unit(7, "id")
    rows = spark.range(2000).select(h.alias("h")).collect()
    values = [r["h"] for r in rows]
    assert all(0 <= v < 1 for v in values) and abs(sum(values) / len(values) - 0.5) < 0.03
    assert values == [r["h"] for r in spark.range(2000).repartition(5).orderBy("id").select(h.alias("h")).collect()]


def test_global_rank_any_partitioning(spark):
    random.seed(1)
    data = [(i, random.random()) for i in range(500)] + [(500 + i, 0.5) for i in range(100)]
    for parts in (1, 7):
        ranked = global_rank(spark.createDataFrame(data, "id int, x double").repartition(parts), ["x", "id"]).collect()
        want = {i: k + 1 for k, (i, _) in enumerate(sorted(data, key=lambda r: (r[1], r[0])))}
        assert {r["id"]: r["rank"] for r in ranked} == want


def test_geometry_and_classes(spark):
    r = spark.range(1).select(bearing(F.lit(1.0), F.lit(0.0)).alias("east"), sector_of(F.lit(359.0)).alias("s"), no2_class(F.lit(4.0)).alias("low"), no2_class(F.lit(101.0)).alias("high")).first()
    assert (r["east"], r["s"], r["low"], r["high"]) == (90.0, 0, 0, 9)
    r = spark.range(1).select(*[k(F.lit(0.0)).alias(n) for n, k in KERNELS.items()]).first()
    assert all(v == 1.0 for v in r)
