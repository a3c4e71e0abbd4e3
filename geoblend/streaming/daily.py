"""The daily means and the per-cell filter over a stream of readings; replayed whole, they equal the batch operators.

The means suit update and append mode, where the watermark drops late rows (complete mode keeps all state and drops none).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import path_exists, shared_folder


#: Added to day numbers as event times: a watermark starts at the epoch, so days up to 0 would count as late (and event times end in 2262).
FIRST_DAY = 30_000


def streaming_daily_mean(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """grid_id, date, source, value, n: tumbling one-day windows; rows later than the watermark are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    days = timed.groupBy(F.window("ts", "1 day"), "grid_id", "source").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return days.select("grid_id", F.to_date("window.start").alias("date"), "source", "value", "n")


def replayed(result: DataFrame, keys: list[str], name: str, mode: str = "update", folder: str | None = None) -> DataFrame:
    """Run a stream over what there is now, its batches written to a table in the shared folder, and read the last row of
    each key (update mode writes a key again when it changes). Nothing passes through the driver."""
    spark = result.sparkSession
    base = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # By number and overwritten: a batch that is run again after a failure replaces its first try.
        batch.write.mode("overwrite").parquet(f"{base}/rows/n_batch={number}")

    run = result.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if not path_exists(spark, f"{base}/rows"):
        return spark.createDataFrame([], result.schema)
    rows = spark.read.parquet(f"{base}/rows")
    rest = [c for c in result.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "n_batch").alias("_r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in result.columns])


def streaming_filter(stream: DataFrame, delay: str = "7 days", q: float = 0.5, r: float = 2.0) -> DataFrame:
    """grid_id, day, mean, var of rows(grid_id, day, value, prior): the random-walk filter with (mean, var, last day) as state.

    Rows wait in their cell's state until the watermark (the latest day less the delay) has passed their day, and are then
    released in the order of days, by a timer where no new row comes. So rows in any order give the batch filter, as
    long as none is later than the delay; later ones are dropped by the watermark and counted (late_rows). A row with a
    null prior and value, such as close_stream writes, only moves time on.
    """
    clock = lambda day: (day + FIRST_DAY) * 86_400
    timed = stream.withColumn("_at", F.timestamp_seconds(clock(F.col("day").cast("long")))).withWatermark("_at", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, var, last, *held = state.get if state.exists else (None, None, None, [], [], [])
        waiting = list(zip(*held))
        for pdf in () if state.hasTimedOut else batches:
            rows = pdf[pdf["prior"].notna() | pdf["value"].notna()]
            waiting += [(int(d), None if pd.isna(v) else float(v), None if pd.isna(p) else float(p)) for d, v, p in zip(rows["day"], rows["value"], rows["prior"])]
        waiting.sort(key=lambda x: x[0])
        now, out = state.getCurrentWatermarkMs(), []
        while waiting and clock(waiting[0][0]) * 1000 <= now:
            day, value, prior = waiting.pop(0)
            if last is not None and day <= last:
                continue
            if last is None:
                mean, var = prior if prior is not None else float("nan"), r
            else:
                var = var + q
                if value is not None:
                    gain = var / (var + r)
                    mean, var = mean + gain * (value - mean), (1 - gain) * var
            last = day
            out.append((key[0], day, mean, var))
        state.update((mean, var, last, *([x[i] for x in waiting] for i in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(clock(waiting[0][0]) * 1000, now + 1))
        yield pd.DataFrame(out, columns=["grid_id", "day", "mean", "var"])

    return timed.groupBy("grid_id").applyInPandasWithState(
        step, "grid_id string, day int, mean double, var double", "mean double, var double, last int, days array<int>, held array<double>, priors array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def close_stream(rows: DataFrame, path: str, days: int = 8) -> None:
    """Add to a written stream folder one row without values, `days` after the last one: when it is read, the watermark passes
    all rows, so nothing waits any longer. It is written after the others, so files in order of time have it last."""
    last = rows.agg(F.max("day").alias("day")).filter("day is not null")
    kinds = {f.name: f.dataType for f in rows.schema}
    empty = [F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in ("day", "grid_id")]
    closing = last.select(F.lit("").cast(kinds["grid_id"]).alias("grid_id"), (F.col("day") + days).cast(kinds["day"]).alias("day"), *empty)
    closing.select(*rows.columns).coalesce(1).write.mode("append").parquet(path)


def late_rows(query) -> int:
    """Rows that the watermark of a finished query dropped, over its kept progress reports."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
