"""Scoring against reference series and earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.transfer import pq_to_nits
from .ordered import pick_by_index
from .samples import FRAME
from .scenes import attach_shot

SHOT_MODES = {"min": F.min, "max": F.max, "mean": F.avg}


def align(ours: DataFrame, reference: DataFrame, how: str = "full") -> DataFrame:
    """Frame-by-frame pairs. A full join keeps the frames that only one side has."""
    return ours.join(reference, FRAME, how)


def count_check(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """Frame counts of both sides per clip and whether they agree."""
    a = ours.groupBy("clip_id").agg(F.count(F.lit(1)).alias("ours"))
    b = reference.groupBy("clip_id").agg(F.count(F.lit(1)).alias("reference"))
    return a.join(b, "clip_id", "full").select(
        "clip_id",
        F.coalesce("ours", F.lit(0)).alias("ours"),
        F.coalesce("reference", F.lit(0)).alias("reference"),
        (F.coalesce("ours", F.lit(0)) == F.coalesce("reference", F.lit(0))).alias("agree"),
    )


def shot_aggregate(series: DataFrame, shots: DataFrame, mode: str, column: str = "value") -> DataFrame:
    if mode not in SHOT_MODES:
        raise ValueError(f"unknown shot aggregate {mode!r}")
    return attach_shot(series, shots).groupBy("clip_id", "shot_id").agg(SHOT_MODES[mode](column).alias("value"))


def error_stats(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bias, mean, median, p95 and maximum of the error, and the worst difference in nits.

    ``pairs`` has ``ref_code`` and ``our_code``. The quantiles are the element at
    floor(n * q) of the sorted absolute errors, capped at the last one.
    """
    keys = keys or ["clip_id"]
    errors = pairs.select(
        *keys,
        (F.col("our_code") - F.col("ref_code")).cast("double").alias("_d"),
        F.abs(pq_to_nits(F.col("our_code") / 4095.0) - pq_to_nits(F.col("ref_code") / 4095.0)).alias("_nits"),
    ).withColumn("_abs", F.abs("_d"))
    plain = errors.groupBy(*keys).agg(
        F.avg("_d").alias("bias"),
        F.avg("_abs").alias("mean_abs"),
        F.max("_abs").alias("max_abs"),
        F.max("_nits").alias("worst_nits"),
    )

    def at(share: float):
        return lambda n: F.least(F.floor(n * F.lit(share)), n - 1)

    picked = pick_by_index(errors, keys, "_abs", {"median_abs": at(0.50), "p95_abs": at(0.95)})
    return plain.join(picked, keys)


def score(pairs: DataFrame, shots: DataFrame | None = None, mode: str = "max") -> DataFrame:
    """Score one metric per frame, or per shot when shots are given."""
    if shots is None:
        return error_stats(pairs)
    both = attach_shot(pairs, shots).groupBy("clip_id", "shot_id").agg(
        SHOT_MODES[mode]("ref_code").alias("ref_code"), SHOT_MODES[mode]("our_code").alias("our_code")
    )
    return error_stats(both)


def match_cuts(ours: DataFrame, reference: DataFrame, tolerance: int = 1) -> DataFrame:
    """Reference cuts that have one of our cuts within ``tolerance`` frames.

    Our cuts are spread over the tolerance first, which turns the band into an equi
    semi join; counting our cuts per spread frame keeps the other side distinct.
    """
    near = ours.select(
        "clip_id", F.explode(F.sequence(F.col("frame_idx") - tolerance, F.col("frame_idx") + tolerance)).alias("frame_idx")
    ).distinct().withColumn("_hit", F.lit(1))
    judged = reference.select(*FRAME).join(near, FRAME, "left")
    ours_n = ours.groupBy("clip_id").agg(F.count(F.lit(1)).alias("ours"))
    return (
        judged.groupBy("clip_id")
        .agg(F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("total"))
        .join(ours_n, "clip_id", "left")
        .select(
            "clip_id",
            "matched",
            "total",
            F.coalesce("ours", F.lit(0)).alias("ours"),
            (F.lit(100.0) * F.col("matched") / F.greatest("total", F.lit(1))).alias("recall_pct"),
        )
    )


def pair_runs(base: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs found in both tables by name, and the baseline runs without a partner."""
    renamed = current.select(*[F.col(c).alias(c if c == "name" else f"cur_{c}") for c in current.columns])
    return base.join(renamed, "name"), base.join(current.select("name"), "name", "left_anti")


def header_deltas(base: DataFrame, current: DataFrame) -> DataFrame:
    paired, _ = pair_runs(base, current)
    return paired.select(
        "name",
        (F.col("cur_scene_count") - F.col("scene_count")).alias("scene_count_delta"),
        (F.col("cur_maxcll") - F.col("maxcll")).alias("maxcll_delta"),
        (F.col("cur_maxfall") - F.col("maxfall")).alias("maxfall_delta"),
    )


def target_delta_p95(base: DataFrame, current: DataFrame) -> DataFrame:
    """Element floor(n * 0.95) of the sorted absolute target deltas, 0 past the end.

    Not comparable when the frame counts differ. Missing targets count as 0. Deltas
    are whole nits below 65 536, so they are counted before they are ordered.
    """
    a = base.select(*FRAME, F.coalesce("target_nits", F.lit(0)).alias("a"), F.lit(1).alias("in_base"))
    b = current.select(*FRAME, F.coalesce("target_nits", F.lit(0)).alias("b"), F.lit(1).alias("in_cur"))
    both = a.join(b, FRAME, "full")
    counts = (
        both.groupBy("clip_id", F.abs(F.col("b") - F.col("a")).alias("delta"))
        .agg(F.count("in_base").alias("_base"), F.count("in_cur").alias("_cur"), F.count(F.lit(1)).alias("n"))
    )
    clip = Window.partitionBy("clip_id")
    upward = clip.orderBy(F.col("delta").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = counts.withColumn("_upto", F.sum("n").over(upward)).withColumn("_all", F.sum("n").over(clip))
    at = F.floor(F.col("_all") * F.lit(0.95))
    agree = F.sum("_base") == F.sum("_cur")
    p95 = F.coalesce(F.min(F.when(at < F.col("_upto"), F.col("delta"))), F.lit(0))
    return seen.groupBy("clip_id").agg(
        F.when(agree, p95.cast("double")).alias("p95"), agree.alias("comparable")
    )


def delta_rows(joined: DataFrame, with_sidecar: bool) -> DataFrame:
    """Rows of the per-frame delta file in its two layouts."""
    def tenth(value):
        # Ties go to the even digit, which the formatter alone would round up.
        return F.format_string("%.1f", F.bround(value, 1))

    if with_sidecar:
        return joined.select(
            "clip_id", F.col("frame_idx").alias("frame"), "ref_min_pq", "our_min_pq", "ref_max_pq",
            tenth(F.col("peak_pq") * 4095).alias("our_max_pq"), "ref_avg_pq", "our_avg_luma_pq", "our_avg_max_rgb_pq",
        )
    return joined.select(
        "clip_id", F.col("frame_idx").alias("frame"), "ref_max_pq",
        tenth(F.col("peak_pq") * 4095).alias("our_max_pq"), "ref_avg_pq",
        tenth(F.col("avg_pq") * 4095).alias("our_avg_pq"),
    )
