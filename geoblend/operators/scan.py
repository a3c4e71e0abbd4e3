"""Filter and smoother of long histories: steps as composable elements, scanned within time blocks and over block ends.

A step of the filter is an element (A, b, C, h, J): given the state before it, its mean and variance after it, and what it
says about the state before. Two elements compose to one, in any bracketing, so blocks of a cell's history are folded
apart from each other, the folds of a cell's blocks are folded in order, and each block is then filtered from the
state that comes in. The smoother composes its backward steps (E, g, L) likewise. So no task holds a cell's history,
only a block of it, or one element for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Days of a block.
BLOCK = 256
ELEMENT = "struct<A:double,b:double,C:double,h:double,J:double>"
BACK = "struct<E:double,g:double,L:double>"
STATE = "struct<day:int,mean:double,var:double,pred_mean:double,pred_var:double,a:double>"


def compose(x: Column, y: Column) -> Column:
    """The element of x and then y."""
    d = 1.0 / (1.0 + x["C"] * y["J"])
    return F.struct(
        (x["A"] * y["A"] * d).alias("A"), (y["A"] * (x["b"] + x["C"] * y["h"]) * d + y["b"]).alias("b"), (y["A"] * y["A"] * x["C"] * d + y["C"]).alias("C"),
        (x["A"] * (y["h"] - y["J"] * x["b"]) * d + x["h"]).alias("h"), (x["A"] * x["A"] * y["J"] * d + x["J"]).alias("J"),
    ).cast(ELEMENT)


def _element(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip("AbChJ", values)]).cast(ELEMENT)


def step_element(x: Column) -> Column:
    """Of a row struct(day, start, mean, value, var, a, q): a first row sets the state; else decay by a with added variance q,
    then a measurement of variance var where there is one."""
    s = x["q"] + x["var"]
    seen = _element(x["var"] / s * x["a"], x["q"] / s * x["value"], x["var"] / s * x["q"], x["a"] * x["value"] / s, x["a"] * x["a"] / s)
    blind = _element(x["a"], 0.0, x["q"], 0.0, 0.0)
    return F.when(x["start"], _element(0.0, x["mean"], x["var"], 0.0, 0.0)).when(x["value"].isNull(), blind).otherwise(seen)


def _in_order(blocks: DataFrame, key: str, element: str, kind: str, unit: Column, join, backward: bool = False) -> DataFrame:
    """key, _b, _in: the composition of the elements of all blocks before (backward: after) each one of its cell."""
    order = F.sort_array(F.collect_list(F.struct("_b", F.col(element).alias("e"))), asc=not backward)
    state = f"struct<now:{kind},out:array<struct<b:long,e:{kind}>>>"
    start = F.struct(unit.alias("now"), F.array().cast(f"array<struct<b:long,e:{kind}>>").alias("out")).cast(state)
    one = lambda s, x: F.concat(s["out"], F.array(F.struct(x["_b"].alias("b"), s["now"].alias("e"))))
    step = lambda s, x: F.struct((join(x["e"], s["now"]) if backward else join(s["now"], x["e"])).alias("now"), one(s, x).alias("out")).cast(state)
    folded = blocks.groupBy(key).agg(order.alias("_e")).select(key, F.explode(F.aggregate("_e", start, step)["out"]).alias("x"))
    return folded.select(key, F.col("x.b").alias("_b"), F.col("x.e").alias("_in"))


def filtered_blocks(rows: DataFrame, key: str) -> DataFrame:
    """key, _b, f (array of STATE in order) of rows(key, _b, _x: struct as in step_element); written."""
    series = written(rows.groupBy(key, "_b").agg(F.sort_array(F.collect_list("_x")).alias("_s")), "scan-series")
    unit = _element(1.0, 0.0, 0.0, 0.0, 0.0)
    folds = series.select(key, "_b", F.aggregate("_s", unit, lambda s, x: compose(s, step_element(x))).alias("_f"))
    incoming = _in_order(folds, key, "_f", ELEMENT, unit, compose)

    def step(states: Column, x: Column) -> Column:
        last = F.try_element_at(states, F.lit(-1))
        pm, pv = x["a"] * last["mean"], x["a"] * x["a"] * last["var"] + x["q"]
        gain = F.when(x["value"].isNotNull(), pv / (pv + x["var"])).otherwise(0.0)
        new = F.struct(x["day"], pm + gain * (F.coalesce(x["value"], pm) - pm), (1 - gain) * pv, pm, pv, x["a"]).cast(STATE)
        return F.concat(states, F.array(F.when(x["start"], F.struct(x["day"], x["mean"], x["var"], x["mean"], x["var"], F.lit(0.0)).cast(STATE)).otherwise(new)))

    # The state that comes in stands before the block's own states; a cell's first row does not look at it.
    came = F.array(F.struct(F.lit(0), F.col("_in")["b"], F.col("_in")["C"], F.col("_in")["b"], F.col("_in")["C"], F.lit(0.0)).cast(STATE))
    states = F.aggregate("_s", came, step)
    met = series.join(incoming, [key, "_b"]).select(key, "_b", F.slice(states, F.lit(2), F.size("_s")).alias("f"))
    return written(met, "scan-filtered")


def _steps(df: DataFrame, key: str, day: str, block: int) -> DataFrame:
    """df with _b, and _before: the day before in its cell, found within blocks and over the blocks' ends."""
    rows = df.withColumn("_b", F.floor(F.col(day) / block))
    ends = rows.groupBy(key, "_b").agg(F.max(day).alias("_end"))
    ends = ends.select(key, "_b", F.lag("_end").over(Window.partitionBy(key).orderBy("_b")).alias("_end"))  # one row a block
    inside = F.lag(day).over(Window.partitionBy(key, "_b").orderBy(day))
    return rows.join(ends, [key, "_b"]).withColumn("_before", F.coalesce(inside, "_end")).drop("_end")


def long_random_walk_filter(df: DataFrame, key: str = "grid_id", day: str = "day", value: str = "value", prior: str = "prior", q: float = 0.5, r: float = 2.0, block: int = BLOCK) -> DataFrame:
    """state.random_walk_filter() of histories of any length: key, day, mean, var."""
    rows = _steps(df.select(key, F.col(day).cast("int").alias("day"), F.col(value).cast("double").alias("value"), F.col(prior).cast("double").alias("prior")), key, "day", block)
    x = F.struct("day", F.col("_before").isNull().alias("start"), F.col("prior").alias("mean"), "value", F.lit(float(r)).alias("var"), F.lit(1.0).alias("a"), F.lit(float(q)).alias("q"))
    out = filtered_blocks(rows.select(key, "_b", x.alias("_x")), key).select(key, F.explode("f").alias("x"))
    return out.select(key, F.col("x.day").alias("day"), F.col("x.mean").alias("mean"), F.col("x.var").alias("var"))


def long_decay_smoother(df: DataFrame, key: str = "grid_id", day: str = "day", mean: str = "mean", var: str = "var", length: float = 5.0, variance: float = 1.0, block: int = BLOCK) -> DataFrame:
    """state.decay_smoother() of histories of any length: key, day, filtered and smoothed mean and var."""
    rows = _steps(df.select(key, F.col(day).cast("int").alias("day"), F.col(mean).cast("double").alias("m"), F.col(var).cast("double").alias("v")), key, "day", block)
    a = F.exp((F.col("_before") - F.col("day")) / F.lit(float(length)))
    x = F.struct("day", F.col("_before").isNull().alias("start"), F.col("m").alias("mean"), F.col("m").alias("value"), F.col("v").alias("var"), F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(variance * (1 - a * a), F.lit(0.0)).alias("q"))
    forward = filtered_blocks(rows.select(key, "_b", x.alias("_x")), key)
    # Each row's backward step needs the prediction of the next row: the next one in the block, or the first of the next block.
    nxt = F.lead(F.col("f")[0]).over(Window.partitionBy(key).orderBy("_b"))
    ends = forward.select(key, "_b", nxt.alias("_next"))
    met = forward.join(ends, [key, "_b"])
    later = F.concat(F.slice("f", F.lit(2), F.size("f")), F.array(F.col("_next")))

    def back(s: Column, n: Column) -> Column:
        e = s["var"] * n["a"] / n["pred_var"]
        own = F.struct(e, s["mean"] - e * n["pred_mean"], s["var"] - e * e * n["pred_var"]).cast(BACK)
        return F.when(n.isNull(), F.struct(F.lit(0.0), s["mean"], s["var"]).cast(BACK)).otherwise(own)

    join = lambda x, y: F.struct(x["E"] * y["E"], x["E"] * y["g"] + x["g"], x["E"] * x["E"] * y["L"] + x["L"]).cast(BACK)
    met = written(met.select(key, "_b", "f", F.zip_with("f", later, back).alias("_s")), "scan-backward")
    unit = F.struct(F.lit(1.0), F.lit(0.0), F.lit(0.0)).cast(BACK)
    folds = met.select(key, "_b", F.aggregate(F.reverse("_s"), unit, lambda s, x: join(x, s)).alias("_f"))
    incoming = _in_order(folds, key, "_f", BACK, unit, join, backward=True)
    pair = "array<struct<g:double,L:double>>"
    step = lambda s, x: F.concat(s, F.array(F.struct((x["E"] * F.element_at(s, -1)["g"] + x["g"]).alias("g"), (x["E"] * x["E"] * F.element_at(s, -1)["L"] + x["L"]).alias("L"))))
    came = F.array(F.struct(F.col("_in")["g"].alias("g"), F.col("_in")["L"].alias("L"))).cast(pair)
    smooth = F.reverse(F.slice(F.aggregate(F.reverse("_s"), came, step), F.lit(2), F.size("_s")))
    out = met.join(incoming, [key, "_b"]).select(key, F.explode(F.arrays_zip("f", smooth.alias("s"))).alias("x"))
    return out.select(key, F.col("x.f.day").alias("day"), F.col("x.f.mean").alias("mean"), F.col("x.f.var").alias("var"), F.col("x.s.g").alias("smooth_mean"), F.col("x.s.L").alias("smooth_var"))
