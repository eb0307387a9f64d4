"""Cutting the frame series into scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import estimators as E
from ..session import staged
from .ordered import CHUNK, greedy_cuts, halo_window, hold_last, previous_row, running_count, with_rank
from .samples import FRAME

DEFAULT_THRESHOLD = 0.3
DEFAULT_MIN_LENGTH = 24
DEFAULT_SMOOTHING = 5
SCENE_METRICS = ("hist", "hybrid")  # both names stand for the same distance


def histogram_distance(frames: DataFrame, rate: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Add ``distance`` to the previous analysed frame; null on the first.

    The rows are numbered per clip, so a missing frame changes nothing but itself.
    """
    analysed = with_rank(frames, ["clip_id"], "frame_idx", "_ord", chunk)
    before = halo_window(
        analysed, ["clip_id"], "_ord", 1, {"_before": lambda w: F.lag("lum_hist").over(w)}, chunk
    )
    distance = F.when(F.col("_before").isNotNull(), E.chi_square(F.col("lum_hist"), F.col("_before")))
    return before.withColumn("distance", distance).drop("_before", "_ord")


def smooth_distance(df: DataFrame, window: int = DEFAULT_SMOOTHING, rate: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Add ``smoothed``: mean of the last ``window`` distances, not reset at cuts."""
    if window <= 0:
        return df.withColumn("smoothed", F.col("distance"))
    analysed = with_rank(df, ["clip_id"], "frame_idx", "_ord", chunk)
    return halo_window(
        analysed,
        ["clip_id"],
        "_ord",
        window - 1,
        {"smoothed": lambda w: F.avg("distance").over(w.rowsBetween(-(window - 1), 0))},
        chunk,
    ).drop("_ord")


def accept_cuts(
    df: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    min_len: int = DEFAULT_MIN_LENGTH,
    chunk: int = CHUNK,
) -> DataFrame:
    """Accepted cuts (clip_id, frame_idx): above the threshold and far enough from the last one.

    The fold starts as if frame 0 had been a cut, so the first cut needs a full scene before it.
    """
    return greedy_cuts(df, ["clip_id"], "frame_idx", F.col("smoothed") > threshold, min_len, chunk)


def attach_scenes(frames: DataFrame, cuts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``scene_id`` (0-based). No interval join: the scene is a running count of cuts."""
    marked = frames.join(cuts.select(*FRAME, F.lit(1).alias("_cut")), FRAME, "left")
    return running_count(marked, ["clip_id"], "frame_idx", F.coalesce("_cut", F.lit(0)), "scene_id", chunk).withColumn(
        "scene_id", F.col("scene_id").cast("int")
    ).drop("_cut")


def scene_bounds(framed: DataFrame) -> DataFrame:
    """Scenes (start, end inclusive) of frames that carry ``scene_id``."""
    return framed.groupBy("clip_id", "scene_id").agg(
        F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end")
    )


def scenes_from_cuts(cuts: DataFrame, frame_counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Scenes from sorted cuts and the frame count per clip; a clip without a cut is one scene."""
    starts = cuts.select(*FRAME).unionByName(frame_counts.select("clip_id", F.lit(0).alias("frame_idx"))).distinct()
    # The end is the next start: the previous row of the mirrored series.
    mirrored = starts.join(frame_counts.select("clip_id", "frame_count"), "clip_id").withColumn(
        "_back", F.col("frame_count") - F.col("frame_idx")
    )
    closed = previous_row(mirrored, ["clip_id"], "_back", {"frame_idx": "_next"}, chunk * 24)
    ranked = running_count(
        closed, ["clip_id"], "frame_idx", F.lit(1), "_nth", chunk * 24
    )
    end = F.coalesce(F.col("_next"), F.col("frame_count")) - 1
    return repair_scenes(
        ranked.select(
            "clip_id",
            (F.col("_nth") - 1).cast("int").alias("scene_id"),
            F.col("frame_idx").alias("start"),
            end.cast("int").alias("end"),
        ),
        frame_counts,
    )


def repair_scenes(scenes: DataFrame, frame_counts: DataFrame) -> DataFrame:
    """Keep starts and ends inside the clip; a reversed range becomes the whole clip."""
    last = F.col("frame_count") - 1
    inside = scenes.join(frame_counts.select("clip_id", "frame_count"), "clip_id")
    end = F.when(F.col("end") > last, last).otherwise(F.col("end"))
    start = F.when(F.col("start") > last, last).otherwise(F.col("start"))
    reversed_ = start > end
    touched = F.col("frame_count") > 0
    return (
        inside.withColumn("_s", F.when(touched & reversed_, F.lit(0)).when(touched, start).otherwise(F.col("start")))
        .withColumn("_e", F.when(touched & reversed_, last).when(touched, end).otherwise(F.col("end")))
        .withColumn("start", F.col("_s").cast("int"))
        .withColumn("end", F.col("_e").cast("int"))
        .drop("_s", "_e", "frame_count")
    )


def attach_ranges(frames: DataFrame, ranges: DataFrame, id_col: str, end_col: str, inclusive: bool) -> DataFrame:
    """Give each frame the range (scene or shot) it lies in.

    The ranges of a clip do not overlap, so the range is the last start at or before the frame: an
    equi join on the start frame and a held value, no interval join.
    """
    starts = ranges.select(
        "clip_id", F.col("start").alias("frame_idx"), F.col(id_col), F.col(end_col).alias("_end")
    )
    marked = frames.join(starts, FRAME, "left")
    held = hold_last(marked, ["clip_id"], "frame_idx", [id_col, "_end"])
    covered = (F.col("frame_idx") <= F.col("_end")) if inclusive else (F.col("frame_idx") < F.col("_end"))
    return held.where(covered).drop("_end")


def attach_scene(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    return attach_ranges(frames, scenes, "scene_id", "end", True)


def attach_shot(frames: DataFrame, shots: DataFrame) -> DataFrame:
    return attach_ranges(frames, shots, "shot_id", "end_excl", False)


def hold_analysed(all_frames: DataFrame, analysed: DataFrame, rate: int) -> DataFrame:
    """Frames that were skipped by sampling take over the last analysed frame's row.

    That is the last row that is there, also where a sampled frame is missing. Frames before the first
    analysed row take that one. ``rate`` is kept for callers; the rows themselves tell what was analysed.
    """
    known = analysed.select(*FRAME, F.col("frame_idx").alias("_from"))
    held = hold_last(all_frames.select(*FRAME).join(known, FRAME, "left"), ["clip_id"], "frame_idx", ["_from"])
    first = known.groupBy("clip_id").agg(F.min("_from").alias("_first"))
    placed = held.join(first, "clip_id").withColumn("_from", F.coalesce("_from", "_first")).drop("_first")
    values = analysed.withColumnRenamed("frame_idx", "_from")
    return placed.join(values, ["clip_id", "_from"]).drop("_from")


def detect_cuts(
    frames: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    min_len: int = DEFAULT_MIN_LENGTH,
    smoothing: int = DEFAULT_SMOOTHING,
    rate: int = 1,
    metric: str = "hist",
) -> DataFrame:
    """W1, W3 and W4 in a row."""
    if metric not in SCENE_METRICS:
        raise ValueError(f"unknown scene metric {metric!r}")
    distances = histogram_distance(frames.select(*FRAME, "lum_hist"), rate).drop("lum_hist")
    smoothed = smooth_distance(distances, smoothing, rate).where(F.col("smoothed") > threshold)
    # The fold reads the few candidates twice, so they are written once.
    return accept_cuts(staged(smoothed.select(*FRAME, "smoothed"), "candidates"), threshold, min_len)


def sort_cuts(cuts: DataFrame) -> DataFrame:
    return cuts.orderBy(*FRAME)

