"""Exact quantiles by distributed selection: counts over value ranges, refined until each wanted rank lies in few values.

A round cuts the range that holds a wanted rank by a sketch of its values, and counts the rows between and at the cuts
exactly. The counts, not the sketch, decide which part holds the rank, so the result is exact whatever the sketch's error;
a value that many rows share is a cut, and is counted, never sorted. When no range holds over `limit` rows its values
are counted one by one and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows of a range that is ranked value by value; cuts of a round; rows of the brackets' table up to which it is broadcast.
LIMIT = 100_000
CUTS = 255
BROADCAST = 100_000


def place_among(cuts: Column, v: Column, most: int) -> Column:
    """How many of the sorted cuts (at most `most`) lie below v, by binary search."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]

    def step(at: Column, jump: Column) -> Column:
        there = at + jump
        return F.when((there <= F.size(cuts)) & (F.get(cuts, there - 1) < v), there).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _near(df: DataFrame) -> DataFrame:
    """df (a row per group and rank) broadcast behind a count."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def selected(rows: DataFrame, wanted: DataFrame, limit: int = LIMIT, cuts: int = CUTS) -> DataFrame:
    """_g, _rank, _v: the values at 0-based ranks; rows(_g, _v) written, wanted(_g, _rank) distinct."""
    # A bracket is an open interval (_a, _b), null for no end, with the rows below it and in it; a found value has _v.
    total = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_in"))
    none = F.lit(None).cast("double")
    state = written(wanted.join(_near(total), "_g").select("_g", "_rank", none.alias("_a"), none.alias("_b"), F.lit(0).cast("long").alias("_below"), "_in", none.alias("_v")), "quantile-brackets")
    inside = (F.col("_a").isNull() | (F.col("_x") > F.col("_a"))) & (F.col("_b").isNull() | (F.col("_x") < F.col("_b")))
    values = rows.select("_g", F.col("_v").alias("_x"))
    while True:
        large = state.filter(F.col("_v").isNull() & (F.col("_in") > limit))
        if not large.take(1):
            break
        # Ranks in one bracket are cut together.
        spans = large.select("_g", "_a", "_b").distinct()
        met = values.join(_near(spans), "_g").filter(inside)
        at = [(i + 1) / (cuts + 1) for i in range(cuts)]
        sketch = met.groupBy("_g", "_a", "_b").agg(F.array_sort(F.array_distinct(F.percentile_approx("_x", at, 4 * cuts))).alias("_cuts"))
        sketch = written(sketch, "quantile-cuts")
        part = place_among(F.col("_cuts"), F.col("_x"), cuts)
        here = F.get("_cuts", part)  # the first cut at or above the value
        counted = values.join(_near(sketch), "_g").filter(inside).withColumn("_p", part)
        counted = counted.groupBy("_g", "_a", "_b", "_p", F.coalesce(F.get("_cuts", F.col("_p")) == F.col("_x"), F.lit(False)).alias("_at"))
        counted = counted.agg(F.count(F.lit(1)).alias("_n"), F.first(F.get("_cuts", F.col("_p") - 1)).alias("_low"), F.first(here).alias("_high"))
        order = Window.partitionBy("_g", "_a", "_b").orderBy("_p", "_at").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * cuts + 1 rows
        counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}"))
        moved = large.alias("s").join(counted.alias("c"), (F.col("s._g") == F.col("c._g")) & same("_a") & same("_b") & (F.col("_rank") - F.col("_below") >= F.col("_before")) & (F.col("_rank") - F.col("_below") < F.col("_before") + F.col("_n")))
        moved = moved.select(
            "s._g", "_rank", F.coalesce("_low", "s._a").alias("_a"), F.coalesce("_high", "s._b").alias("_b"), (F.col("_below") + F.col("_before")).alias("_below"),
            F.col("_n").alias("_in"), F.when(F.col("_at"), F.col("_high")).alias("_v"),
        )
        state = written(moved.union(state.filter(F.col("_v").isNotNull() | (F.col("_in") <= limit))), "quantile-brackets")
    few = state.filter("_v is null")
    spans = few.select("_g", "_a", "_b", "_below").distinct()
    counts = values.join(_near(spans), "_g").filter(inside).groupBy("_g", "_a", "_b", "_below", "_x").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_g", "_a", "_b").orderBy("_x")  # at most `limit` values
    ranked = counts.select("_g", "_a", "_b", "_x", (F.col("_below") + F.sum("_n").over(upto)).alias("_end"), "_n")
    same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}"))
    last = few.alias("s").join(ranked.alias("c"), (F.col("s._g") == F.col("c._g")) & same("_a") & same("_b") & (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    return state.filter("_v is not null").select("_g", "_rank", "_v").union(last.select("s._g", "_rank", F.col("_x").alias("_v")))


def exact_quantiles(df: DataFrame, value: Column | str, probs: list[float], by: list[str] | None = None, name: str = "q", limit: int = LIMIT, cuts: int = CUTS) -> DataFrame:
    """by, n, name (array of quantiles, linear between ranks) of each group's values that are not null; without `by` one
    row, of nulls where there is no value. NaN is greater than any number, as in Spark's order."""
    value, keys = F.col(value) if isinstance(value, str) else value, list(by or [])
    group = F.struct(*keys) if keys else F.lit(0)
    rows = written(df.select(group.alias("_g"), value.cast("double").alias("_v")).filter("_v is not null"), "quantile-rows")
    sizes = written(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")), "quantile-sizes")
    p = F.array(*[F.lit(float(x)) for x in probs])
    asked = sizes.select("_g", F.explode(F.transform(p, lambda x: (F.col("n") - 1) * x)).alias("_pos"))
    wanted = asked.select("_g", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_rank")).distinct()
    found = selected(rows, wanted, limit, cuts).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(x: Column) -> Column:
        pos = (F.col("n") - 1) * x
        low, high = F.col("_at")[F.floor(pos)], F.col("_at")[F.ceil(pos)]
        return F.when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    out = sizes.join(found, "_g").select("_g", "n", F.transform(p, between).alias(name))
    if keys:
        return out.select(*[F.col("_g")[k].alias(k) for k in keys], "n", name)
    one = df.sparkSession.range(1).select(F.lit(0).alias("_g"))
    return one.join(out, "_g", "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(name, F.transform(p, lambda x: F.lit(None).cast("double"))).alias(name))
