"""Streams that meet frames out of order and late."""

import os
import random
import uuid

from pyspark.sql import functions as F

from lumaspark.streaming import live as L

FRAMES = "clip_id STRING, frame_idx INT, lum_hist ARRAY<DOUBLE>, raw_target INT, ts TIMESTAMP"


def hist(frame):
    values = [0.0] * 256
    values[(frame // 30) * 40 % 256] = 100.0
    return values


def run(spark, tmp_path, batches, **options):
    """Feed the batches one by one, each in its own file, and return the rows."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    base = 1_704_067_200
    for number, frames in enumerate(batches):
        rows = [("a", f, hist(f), 100 + f * 50 % 900) for f in frames]
        df = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, lum_hist ARRAY<DOUBLE>, raw_target INT")
        df.withColumn("ts", F.timestamp_seconds(F.col("frame_idx").cast("bigint") + base)).coalesce(1).write.mode("append").parquet(str(source / f"{number:03d}"))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    live = L.live_cuts_and_targets(stream, delay="20 seconds", threshold=50.0, smoothing=0, max_delta=100, **options)
    query = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"c{uuid.uuid4().hex}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(spark.read.parquet(out).collect(), key=lambda r: r.frame_idx), query


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    """Frames wait in the state while the query is down; a new query over the same checkpoint gives the rows of one that never stopped."""
    rng = random.Random(9)
    frames = [f for f in range(90) if f not in (31, 32)]
    batches = [rng.sample(frames[a:a + 22], 22) for a in (0, 22, 44, 66)]
    batches[0].remove(7), batches[3].append(7)  # later than the watermark of 20 seconds allows
    whole, _ = run(spark, tmp_path / "whole", batches)
    base, out = 1_704_067_200, str(tmp_path / "parts" / "out")
    source = tmp_path / "parts" / "in"
    for number, part in enumerate(batches):
        rows = [("a", f, hist(f), 100 + f * 50 % 900) for f in part]
        df = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, lum_hist ARRAY<DOUBLE>, raw_target INT")
        df.withColumn("ts", F.timestamp_seconds(F.col("frame_idx").cast("bigint") + base)).coalesce(1).write.mode("append").parquet(str(source / f"{number:03d}"))
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
        live = L.live_cuts_and_targets(stream, delay="20 seconds", threshold=50.0, smoothing=0, max_delta=100)
        live.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "parts" / "state")).trigger(availableNow=True).start().awaitTermination()
    parts = sorted(spark.read.parquet(out).collect(), key=lambda r: r.frame_idx)
    seen = [r.frame_idx for r in parts]
    assert len(seen) == len(set(seen)) and {7, 31, 32}.isdisjoint(seen)
    # The watermark moves at a stop as well, so the stopped query may have passed more; what both have is equal.
    assert seen[: len(whole)] == [r.frame_idx for r in whole]
    drop = lambda r: {k: v for k, v in r.asDict().items() if k != "dropped"}
    assert [drop(r) for r in parts[: len(whole)]] == [drop(r) for r in whole]


def test_order_is_restored(spark, tmp_path):
    frames = list(range(120))
    rng = random.Random(4)
    batches = []
    for first in range(0, 120, 10):
        part = frames[first:first + 10]
        rng.shuffle(part)
        batches.append(part)
    batches[3][0], batches[4][0] = batches[4][0], batches[3][0]
    rows, _ = run(spark, tmp_path, batches)
    assert [r.frame_idx for r in rows] == frames
    assert [r.frame_idx for r in rows if r.is_cut] == [30, 60, 90]
    target = None
    for r in rows:
        want = 100 + r.frame_idx * 50 % 900
        target = want if target is None else max(target - 100, min(target + 100, want))
        assert r.target_nits == target


def test_a_lost_frame_is_passed_over(spark, tmp_path):
    batches = [[f for f in range(first, first + 10) if f != 25] for first in range(0, 120, 10)]
    rows, _ = run(spark, tmp_path, batches)
    seen = [r.frame_idx for r in rows]
    assert 25 not in seen and seen[:25] == list(range(25)) and seen[25] == 26 and len(seen) >= 90
    assert [r.frame_idx for r in rows if r.is_cut][:2] == [30, 60]


def test_source_files_arrive_in_the_order_of_time(spark):
    """A file stream takes files by their age, so ranges that end late must not be older than those before them."""
    from lumaspark.workbench import live as W

    # The first ranges take longest to write.
    rows = spark.range(40_000).select(
        F.timestamp_seconds(F.col("id")).alias("ts"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") < 10_000, 200).otherwise(1)).alias("text")
    )
    path = W.source(rows, spark).select(F.input_file_name().alias("path"), "ts")
    seen = W.drain(path, spark).groupBy("path").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).collect()
    spans = [(r["low"], r["high"]) for r in sorted(seen, key=lambda r: os.stat(r["path"].removeprefix("file://").removeprefix("file:")).st_mtime_ns)]
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
