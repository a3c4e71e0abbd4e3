"""Per-cell state recursions over ordered days, as array expressions: filter and smoother.

A cell's days are collected into one sorted array (days per cell are at most a few thousand) and folded with
aggregate(); cells are spread over the cluster by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = "struct<day:int,mean:double,var:double,pred_mean:double,pred_var:double,a:double>"


def transitions(days: DataFrame, day: str = "day", length: float = 5.0, variance: float = 1.0) -> DataFrame:
    """dt, a = exp(-dt / length), q = variance * (1 - a^2) of each distinct day to the one before (first: dt null, a 0, q variance)."""
    table = days.select(day).distinct()
    dt = F.col(day) - F.lag(day).over(Window.orderBy(day))
    a = F.coalesce(F.exp(-F.col("dt") / length), F.lit(0.0))
    return table.withColumn("dt", dt).withColumn("a", a).withColumn("q", variance * (1 - F.col("a") * F.col("a")))


def _series(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_s"))


def _append(states: Column, new: Column) -> Column:
    return F.concat(states, F.array(new.cast(STATE)))


def random_walk_filter(df: DataFrame, key: str = "grid_id", day: str = "day", value: str = "value", prior: str = "prior", q: float = 0.5, r: float = 2.0) -> DataFrame:
    """key, day, mean, var: random-walk Kalman filter per cell. The first day has the prior as its state (variance r);
    a missing measurement only predicts."""
    rows = _series(df.select(key, F.col(day).cast("int").alias("day"), F.col(value).cast("double").alias("value"), F.col(prior).cast("double").alias("prior")), key, ["day", "value", "prior"])

    def step(states: Column, x: Column) -> Column:
        last = F.try_element_at(states, F.lit(-1))
        p = last["var"] + q
        gain = F.when(x["value"].isNotNull(), p / (p + r)).otherwise(0.0)
        mean = last["mean"] + gain * (F.coalesce(x["value"], last["mean"]) - last["mean"])
        new = F.struct(x["day"], mean, (1 - gain) * p, last["mean"], p, F.lit(1.0))
        first = F.struct(x["day"], x["prior"], F.lit(float(r)), x["prior"], F.lit(float(r)), F.lit(1.0))
        return _append(states, F.when(F.size(states) == 0, first.cast(STATE)).otherwise(new.cast(STATE)))

    out = rows.select(key, F.explode(F.aggregate("_s", F.array().cast(f"array<{STATE}>"), step)).alias("x"))
    return out.select(key, F.col("x.day").alias("day"), F.col("x.mean").alias("mean"), F.col("x.var").alias("var"))


def decay_smoother(df: DataFrame, key: str = "grid_id", day: str = "day", mean: str = "mean", var: str = "var", length: float = 5.0, variance: float = 1.0, floor: float = 1e-12) -> DataFrame:
    """key, day, filtered and smoothed mean and var: forward filter with decay to 0 (daily predictions are measurements
    with their variance), then the backward smoother. A single day passes through."""
    rows = _series(df.select(key, F.col(day).cast("int").alias("day"), F.col(mean).cast("double").alias("m"), F.col(var).cast("double").alias("v")), key, ["day", "m", "v"])

    def step(states: Column, x: Column) -> Column:
        last = F.try_element_at(states, F.lit(-1))
        a = F.exp(-(x["day"] - last["day"]) / F.lit(float(length)))
        pm, pv = a * last["mean"], a * a * last["var"] + variance * (1 - a * a)
        gain = pv / (pv + x["v"])
        new = F.struct(x["day"], pm + gain * (x["m"] - pm), F.greatest((1 - gain) * pv, F.lit(floor)), pm, pv, a)
        first = F.struct(x["day"], x["m"], x["v"], x["m"], x["v"], F.lit(0.0))
        return _append(states, F.when(F.size(states) == 0, first.cast(STATE)).otherwise(new.cast(STATE)))

    forward = rows.select(key, F.aggregate("_s", F.array().cast(f"array<{STATE}>"), step).alias("f"))
    smooth = "struct<day:int,mean:double,var:double,smooth_mean:double,smooth_var:double,next_pm:double,next_pv:double,next_a:double>"

    def back(out: Column, x: Column) -> Column:
        nxt = F.try_element_at(out, F.lit(-1))
        gain = x["var"] * nxt["next_a"] / nxt["next_pv"]
        m = x["mean"] + gain * (nxt["smooth_mean"] - nxt["next_pm"])
        v = F.greatest(x["var"] + gain * gain * (nxt["smooth_var"] - nxt["next_pv"]), F.lit(floor))
        new = F.struct(x["day"], x["mean"], x["var"], m, v, x["pred_mean"], x["pred_var"], x["a"]).cast(smooth)
        last = F.struct(x["day"], x["mean"], x["var"], x["mean"], x["var"], x["pred_mean"], x["pred_var"], x["a"]).cast(smooth)
        return F.concat(out, F.array(F.when(F.size(out) == 0, last).otherwise(new)))

    done = forward.select(key, F.explode(F.aggregate(F.reverse("f"), F.array().cast(f"array<{smooth}>"), back)).alias("x"))
    return done.select(key, "x.day", F.col("x.mean").alias("mean"), F.col("x.var").alias("var"), "x.smooth_mean", "x.smooth_var")
