"""Streams over the driver's tables, run to completion and compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import transfer as T
from ..operators import measure
from ..session import stage_dir, staged
from ..streaming import live as L
from . import adapters as A
from . import ordered as W
from .pixels import FINE_SQL, low_sql
from .registry import query
from .scalars import six

FRAME = ["clip_id", "frame_idx"]
KEY = "clip_id, frame_idx"
CLOSING = -1


def at(frame):
    """Event time of a frame: one second per frame from a fixed day (the first watermark is the epoch)."""
    return F.timestamp_seconds(frame.cast("bigint") + 1_704_067_200)


def drain(stream, spark, mode: str = "append"):
    """Run a stream over what is there and return its sink as a table."""
    base = f"{stage_dir(spark)}/lumaspark-stream-{uuid.uuid4().hex}"
    if mode == "append":
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        run.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch, number):
        # A batch that is run again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep)
    run.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def source(df, spark):
    """The table as a file stream in the order of time, a few files per batch; Spark's shuffle decides on the number of
    files, so it grows with the table.

    A file stream takes files by their age. Tasks end in any order, so the ranges are written side by side first and then
    arrive one after the other, as they would live."""
    base = f"{stage_dir(spark)}/lumaspark-source-{uuid.uuid4().hex}"
    df.repartitionByRange("ts").withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{base}/ranges")
    ranges = spark.read.parquet(f"{base}/ranges").select("_range").distinct().orderBy("_range")
    for r in ranges.toLocalIterator():
        part = spark.read.schema(df.schema).parquet(f"{base}/ranges/_range={r['_range']}")
        part.coalesce(1).write.mode("append").parquet(f"{base}/arrived")
    base = f"{base}/arrived"
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(base)


def _live_samples(spark, sf_dir):
    """The samples and a closing row per clip, a day after all others, that lets the watermark pass the last frame.
    The closing frame has the number -1, which no frame has."""
    given = A.samples(spark, sf_dir).withColumn("ts", at(F.col("frame_idx")))
    last = given.groupBy("clip_id").agg(F.max("frame_idx").alias("_last"))
    closing = last.select(
        "clip_id", F.lit(CLOSING).alias("frame_idx"), F.lit(512).alias("cb_code"), F.lit(512).alias("cr_code"), F.lit(64).alias("y_code"), at(F.col("_last") + 86_400).alias("ts")
    )
    return source(given.unionByName(closing), spark)


@query("t1_live_measure", f"""
    SELECT m.*, round(coalesce(lo.bin, lo.top) / 4095.0::DOUBLE, 6) AS min_pq FROM
      (SELECT {KEY}, round(max({A.sql_max_rgb()}), 6) AS peak_pq, round(avg({A.sql_luma()}), 6) AS avg_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL) m JOIN ({low_sql(FINE_SQL, 0.1)}) lo USING (clip_id, frame_idx)""")
def t1(spark, sf_dir):
    frames = drain(L.live_measure(_live_samples(spark, sf_dir).drop("x")).select(*FRAME, "peak_pq", "avg_pq", "min_pq"), spark)
    return frames.where(F.col("frame_idx") != CLOSING).select(*FRAME, *[six(F.col(c), c) for c in ("peak_pq", "avg_pq", "min_pq")])


def _live_frames(spark, sf_dir):
    measured = measure.measure_frames(A.samples(spark, sf_dir)).select(
        *FRAME, "lum_hist", (F.round(T.pq_to_nits("peak_pq"))).cast("int").alias("raw_target"), at(F.col("frame_idx")).alias("ts")
    )
    return source(measured, spark)


@query("t2_live_cuts", W.MEASURE_CUTS_SQL)
def t2(spark, sf_dir):
    return drain(L.live_cuts(_live_frames(spark, sf_dir), threshold=W.THRESHOLD, delay="60 seconds"), spark)


_RAW = f"SELECT {KEY}, round({A.sql_pq_to_nits(f'max({A.sql_max_rgb()})')})::INT AS v FROM ({A.SAMPLES_SQL}) GROUP BY ALL"
_HELD = f"SELECT f.clip_id, f.frame_idx, h.v FROM ({_RAW}) f JOIN ({_RAW}) h ON h.clip_id = f.clip_id AND h.frame_idx = f.frame_idx - f.frame_idx % 3"


@query("t3_live_targets", f"""SELECT clip_id, frame_idx, (frame_idx - frame_idx % 3)::INT AS held_from, p AS target_nits FROM ({W.limit_sql(_HELD, 'v', 'clip_id', 'frame_idx', 200)})""")
def t3(spark, sf_dir):
    targets = L.live_targets(_live_frames(spark, sf_dir), threshold=W.THRESHOLD, rate=3, delay="60 seconds")
    return drain(targets, spark).select(*FRAME, "held_from", "target_nits")


@query("t4_live_totals", f"""
    SELECT clip_id, max(round({A.sql_pq_to_nits('peak_pq')}))::INT AS maxcll, round(max({A.sql_pq_to_nits('avg_pq')}))::INT AS maxfall, round(avg({A.sql_pq_to_nits('avg_pq')}))::INT AS avgfall, count(*) AS frame_count
    FROM ({W.SERIES_FRAMES_SQL}) GROUP BY clip_id""")
def t4(spark, sf_dir):
    frames = W.series_frames(spark, sf_dir).select(*FRAME, "peak_pq", "avg_pq", at(F.col("frame_idx")).alias("ts"))
    updates = staged(drain(L.live_totals(source(frames, spark)), spark, "update"), "totals")
    newest = updates.groupBy("clip_id").agg(F.max_by(F.struct("maxcll", "maxfall", "avgfall", "frame_count"), "batch").alias("t"))
    return newest.select("clip_id", "t.*")
