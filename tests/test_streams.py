import random
import time
import uuid

from pyspark.sql import functions as F

from geoblend.operators.daily import daily_mean
from geoblend.operators.state import random_walk_filter
from geoblend.streaming.daily import close_stream, late_rows, replayed, streaming_daily_mean, streaming_filter


def replay(spark, df, tmp_path, make, mode):
    path = str(tmp_path / "in")
    df.write.parquet(path)
    name = f"t{uuid.uuid4().hex}"
    run = make(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch_means(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("grid_id"), F.timestamp_seconds(1704067200 + F.col("id") * 3000).alias("ts"), F.lit("s").alias("source"), (F.col("id") * 1.5).alias("value"))
    got = {(r["grid_id"], r["date"]): r["value"] for r in replay(spark, df, tmp_path, streaming_daily_mean, "complete").collect()}
    assert got == {(r["grid_id"], r["date"]): r["value"] for r in daily_mean(df).collect()}


def days_stream(spark, folder, batches):
    """A folder of one file a batch, read one file at a time, closed at the end."""
    schema = "grid_id string, day int, value double, prior double"
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their times
    close_stream(spark.createDataFrame([r for b in batches for r in b], schema), folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same_states(got, want):
    got, want = ({(r["grid_id"], r["day"]): (r["mean"], r["var"]) for r in x.collect()} for x in (got, want))
    return got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_stream_in_any_order_equals_batch_filter(spark, tmp_path):
    """Days come up to five days late, in four batches, each in no order."""
    rng = random.Random(5)
    rows = [(c, d - 3, None if d % 3 == 0 else float(d + len(c)), 5.0) for c in ("a", "bb", "c") for d in range(30) if c != "c" or d < 4]
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 5))
    batches = [arrival[i : i + len(rows) // 4 + 1] for i in range(0, len(rows), len(rows) // 4 + 1)]
    for b in batches:
        rng.shuffle(b)
    assert any(x[1] > y[1] for a, b in zip(batches, batches[1:]) for x in a for y in b)
    stream = days_stream(spark, str(tmp_path / "in"), batches)
    got = replayed(streaming_filter(stream, "7 days"), ["grid_id", "day"], "ordered", "append", str(tmp_path))
    assert same_states(got, random_walk_filter(spark.createDataFrame(rows, "grid_id string, day int, value double, prior double")))


def test_rows_later_than_the_delay_are_dropped_and_counted(spark, tmp_path):
    first = [("a", 19_000 + d, float(d), 5.0) for d in (0, 1, 3)]
    batches = [first, [("a", 19_020, 7.0, 5.0)], [("a", 19_021, 8.0, 5.0)], [("a", 19_002, 100.0, 5.0), ("a", 19_019, 6.0, 5.0)]]  # the last batch holds one row too late, one in time
    stream = days_stream(spark, str(tmp_path / "in"), batches)
    name = f"t{uuid.uuid4().hex}"
    run = streaming_filter(stream, "3 days").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(240)
    kept = [r for b in batches for r in b if r[1] != 19_002]
    assert late_rows(run) == 1
    assert same_states(spark.table(name), random_walk_filter(spark.createDataFrame(kept, "grid_id string, day int, value double, prior double")))


def test_late_rows_are_dropped(spark, tmp_path):
    """Four files, one a batch: the second's watermark is in force from the third on, so the fourth's late row goes."""
    rows = [[("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 12:00:00", 3.0)], [("a", "2024-01-05 10:00:00", 5.0)], [("a", "2024-01-05 10:30:00", 6.0)], [("a", "2024-01-01 11:00:00", 100.0), ("a", "2024-01-05 11:00:00", 7.0)]]
    for i, part in enumerate(rows):
        df = spark.createDataFrame([(g, t, "s", v) for g, t, v in part], "grid_id string, t string, source string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for mode in ("update", "append"):
        got = {str(r["date"]): (r["value"], r["n"]) for r in replayed(streaming_daily_mean(stream), ["grid_id", "date", "source"], "late", mode, str(tmp_path)).collect()}
        assert got["2024-01-01"] == (2.0, 2)
        assert got.get("2024-01-05") == ((6.0, 3) if mode == "update" else None)  # append: the last day is still open
