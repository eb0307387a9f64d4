"""From frames to scenes and clip headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.transfer import c_pq_to_nits, gamut_peaks, pq12, pq_to_nits
from .samples import FRAME

SCENE = ["clip_id", "scene_id"]
HEADER_SHARES = {"histogram99": 0.99, "histogram999": 0.999}


def percentile_index(count, share: float):
    """Zero-based index ceil(share * count - 1), kept inside the list."""
    raw = F.greatest(F.ceil(F.lit(share) * count - 1), F.lit(0))
    return F.least(raw, count - 1)


def max_cll(frames: DataFrame, source: str = "max") -> DataFrame:
    """MaxCLL per clip in whole nits.

    Frames are counted by whole-nit peak first: at most 10 001 rows per clip reach the window.
    """
    nits = F.round(c_pq_to_nits("peak_pq")).cast("int").alias("nits")
    if source not in HEADER_SHARES:
        return frames.select("clip_id", nits).groupBy("clip_id").agg(F.max("nits").alias("maxcll"))
    counts = frames.select("clip_id", nits).groupBy("clip_id", "nits").agg(F.count(F.lit(1)).alias("n"))
    upward = Window.partitionBy("clip_id").orderBy("nits").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("clip_id")
    seen = counts.withColumn("_upto", F.sum("n").over(upward)).withColumn("_all", F.sum("n").over(whole))
    at = percentile_index(F.col("_all"), HEADER_SHARES[source])
    return seen.where(at < F.col("_upto")).groupBy("clip_id").agg(F.min("nits").alias("maxcll"))


def fall(frames: DataFrame) -> DataFrame:
    return (
        frames.select("clip_id", c_pq_to_nits("avg_pq").alias("_nits"))
        .groupBy("clip_id")
        .agg(
            F.round(F.max("_nits")).cast("int").alias("maxfall"),
            F.round(F.avg("_nits")).cast("int").alias("avgfall"),
        )
    )


def clip_levels(frames: DataFrame, peak_source: str = "max") -> DataFrame:
    """frame_count, maxcll, maxfall and avgfall per clip from one pass over the frames.

    Frames are summed by whole-nit peak first, so at most 10 001 narrow rows per clip are left to order.
    """
    average = c_pq_to_nits("avg_pq")
    by_peak = frames.groupBy("clip_id", F.round(c_pq_to_nits("peak_pq")).cast("int").alias("nits")).agg(
        F.count(F.lit(1)).alias("n"), F.count(average).alias("_known"), F.max(average).alias("_max"), F.sum(average).alias("_sum")
    )
    cll = F.max("nits")
    if peak_source in HEADER_SHARES:
        whole = Window.partitionBy("clip_id")
        upward = whole.orderBy("nits").rowsBetween(Window.unboundedPreceding, 0)
        at = percentile_index(F.sum("n").over(whole), HEADER_SHARES[peak_source])
        by_peak = by_peak.withColumn("_reached", at < F.sum("n").over(upward))
        cll = F.min(F.when(F.col("_reached"), F.col("nits")))
    return by_peak.groupBy("clip_id").agg(
        F.sum("n").cast("int").alias("frame_count"), cll.alias("maxcll"), F.round(F.max("_max")).cast("int").alias("maxfall"),
        F.round(F.sum("_sum") / F.sum("_known")).cast("int").alias("avgfall"),
    )


def headers(
    frames: DataFrame,
    scenes: DataFrame,
    version: int = 5,
    optimizer: bool = True,
    target_peak: int | None = None,
    peak_source: str = "max",
) -> DataFrame:
    """One header row per clip."""
    scene_counts = scenes.groupBy("clip_id").agg(F.count(F.lit(1)).cast("int").alias("scene_count"))
    joined = clip_levels(frames, peak_source).join(scene_counts, "clip_id", "left")
    target = F.lit(None).cast("int")
    if version >= 6:
        target = F.col("maxcll") if target_peak is None else F.lit(target_peak)
    return joined.select(
        "clip_id",
        F.lit(version).alias("version"),
        F.coalesce("scene_count", F.lit(0)).alias("scene_count"),
        "frame_count",
        F.lit(3 if optimizer else 2).alias("flags"),
        "maxcll",
        "maxfall",
        "avgfall",
        target.alias("target_peak_nits"),
    )


def with_gamut_peaks(frames: DataFrame, version: int = 6) -> DataFrame:
    if version < 6:
        return frames
    p3, bt709 = gamut_peaks("peak_pq")
    return frames.withColumn("peak_pq_p3", p3).withColumn("peak_pq_709", bt709)


def scene_stats(framed: DataFrame) -> DataFrame:
    """Scenes table: bounds, mean average and truncated peak in nits."""
    return framed.groupBy(*SCENE).agg(
        F.min("frame_idx").alias("start"),
        F.max("frame_idx").alias("end"),
        c_pq_to_nits(F.max("peak_pq")).cast("int").alias("peak_nits"),
        F.avg("avg_pq").alias("avg_pq"),
    )


def scene_l1(framed: DataFrame) -> DataFrame:
    """Scene minimum, means and maximum as 12-bit codes."""
    return framed.groupBy(*SCENE).agg(
        F.min("frame_idx").alias("start"),
        F.max("frame_idx").alias("end"),
        pq12(F.least(F.min("min_pq"), F.lit(1.0))).alias("min_pq_12bit"),
        pq12(F.avg("avg_pq")).alias("avg_luma_pq_12bit"),
        pq12(F.avg("avg_max_rgb_pq")).alias("avg_max_rgb_pq_12bit"),
        pq12(F.greatest(F.max("peak_pq"), F.lit(0.0))).alias("max_pq_12bit"),
    )


def frame_summary(frames: DataFrame) -> DataFrame:
    """Largest and mean peak and average per clip with their nits, and the targets."""
    summary = frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("peak_pq").alias("max_peak_pq"),
        F.avg("peak_pq").alias("avg_peak_pq"),
        F.max("avg_pq").alias("max_avg_pq"),
        F.avg("avg_pq").alias("avg_avg_pq"),
        F.count("target_nits").alias("with_target"),
        F.avg("target_nits").alias("avg_target_nits"),
    )
    for name in ("max_peak", "avg_peak", "max_avg", "avg_avg"):
        summary = summary.withColumn(f"{name}_nits", pq_to_nits(f"{name}_pq"))
    return summary


def frame_l1(frames: DataFrame) -> DataFrame:
    """Per-frame 12-bit codes of the sidecar."""
    return frames.select(
        *FRAME,
        pq12("min_pq").alias("min_pq_12bit"),
        pq12("avg_pq").alias("avg_luma_pq_12bit"),
        pq12("avg_max_rgb_pq").alias("avg_max_rgb_pq_12bit"),
    )
