"""Exact quantiles and global ranks against numpy, on even, hot and empty values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoblend.functions.numerics import global_rank
from geoblend.functions.quantiles import exact_quantiles, place_among

PROBS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


def values(kind, rng, n):
    if kind == "hot":  # nine of ten rows share a value
        return [7.5 if rng.random() < 0.9 else rng.gauss(0, 100) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200) for _ in range(n)]
    if kind == "few":
        return [float(rng.randrange(5)) for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("limit,cuts", [(100_000, 255), (50, 7), (1, 3)])
def test_quantiles_by_group(spark, limit, cuts):
    rng = random.Random(1)
    groups = {(k, i): values(k, rng, n) for k in ("even", "hot", "wide", "few") for i, n in enumerate((1, 2, 700))}
    rows = [(k, i, v) for (k, i), vs in groups.items() for v in vs] + [("even", 1, None), ("none", 0, None), (None, 5, 3.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    got = {(r["k"], r["i"]): r for r in exact_quantiles(df, "v", PROBS, ["k", "i"], limit=limit, cuts=cuts).collect()}
    assert set(got) == {*groups, (None, 5)}
    for key, vs in groups.items():
        assert got[key]["n"] == len(vs) and got[key]["q"] == pytest.approx(list(np.quantile(vs, PROBS)), rel=1e-12), key


def test_quantiles_of_all_rows(spark):
    rng = random.Random(2)
    vs = values("hot", rng, 3000)
    df = spark.createDataFrame([(v, "clash", 1) for v in vs], "v double, _g string, q int")
    got = exact_quantiles(df, F.col("v") * 2, [0.5, 0.99], limit=20, cuts=15).collect()
    assert len(got) == 1 and got[0]["q"] == pytest.approx(list(np.quantile(np.array(vs) * 2, [0.5, 0.99])))
    none = exact_quantiles(df.limit(0), "v", [0.5, 0.9]).collect()
    assert [(r["n"], r["q"]) for r in none] == [(0, [None, None])]


def test_place_among(spark):
    cuts = [1.0, 3.0, 3.5, 9.0, 12.0]
    df = spark.createDataFrame([(float(x) / 2,) for x in range(30)], "v double")
    got = df.select("v", place_among(F.array(*map(F.lit, cuts)), F.col("v"), len(cuts)).alias("p"), place_among(F.array(F.lit(2.0)), F.col("v"), 7).alias("one")).collect()
    assert [(r["p"], r["one"]) for r in got] == [(sum(c < r["v"] for c in cuts), int(2.0 < r["v"])) for r in got]


@pytest.mark.parametrize("buckets", [None, 1, 9])
def test_global_rank_splits_hot_values(spark, buckets):
    rng = random.Random(3)
    rows = [(7.0 if rng.random() < 0.9 else rng.random(), f"id{i:05d}", None if i % 50 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "v double, id string, rest int").repartition(6)
    got = global_rank(df, ["v", "id"], "rank", buckets)
    assert got.columns == ["v", "id", "rest", "rank"]
    assert [(r["v"], r["id"]) for r in got.orderBy("rank").collect()] == sorted((v, i) for v, i, _ in rows)
    assert sorted(r["rank"] for r in got.select("rank").collect()) == list(range(1, 2001))
    ties = global_rank(df.select(F.lit(1).alias("v")), ["v"], buckets=buckets)  # nothing to order by: any order, each rank once
    assert sorted(r["rank"] for r in ties.collect()) == list(range(1, 2001)) and global_rank(df.limit(0), ["v"]).collect() == []
