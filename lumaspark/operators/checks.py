"""Consistency rules. Each yields rows (clip_id, item, rule, severity, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.transfer import c_pq_to_nits
from .ordered import previous_row

FALL_FLOOR_NITS, FALL_SHARE = 10.0, 0.02
DOMAIN_SLACK = 0.25 / 4095.0
MAX_BIAS_CODES = 25.0


def violations(df: DataFrame, *rules: tuple[Column, object, str, str, Column]) -> DataFrame:
    """The broken rules (condition, item, name, severity, detail) of every row, in one pass over ``df``."""

    def found(condition: Column, item, rule: str, severity: str, detail: Column) -> Column:
        number = F.col(item) if isinstance(item, str) else item
        return F.when(condition, F.struct(
            number.cast("int").alias("item"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"),
        ))

    broken = F.array_compact(F.array(*[found(*rule) for rule in rules]))
    return df.select("clip_id", F.explode(broken).alias("_v")).select("clip_id", "_v.*")


def violation(df: DataFrame, condition: Column, item, rule: str, severity: str, detail: Column) -> DataFrame:
    return violations(df, (condition, item, rule, severity, detail))


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frame_count"))


def _judged_scenes(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    counted = scenes.join(frame_counts(frames), "clip_id")
    reversed_ = F.col("end") < F.col("start")
    outside = (F.col("start") >= F.col("frame_count")) | (F.col("end") >= F.col("frame_count"))
    return counted.withColumn("_reversed", reversed_).withColumn("_outside", ~reversed_ & outside)


def check_scene_ranges(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    judged = _judged_scenes(scenes, frames)
    span = F.concat_ws("-", "start", "end")
    return violations(
        judged,
        (F.col("_reversed"), "scene_id", "scene_reversed", "warning", span),
        (F.col("_outside"), "scene_id", "scene_outside", "warning", span),
    )


def check_scene_coverage(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    valid = _judged_scenes(scenes, frames).where(~F.col("_reversed") & ~F.col("_outside"))
    covered = valid.groupBy("clip_id", "frame_count").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("covered")
    )
    return violation(
        covered, F.col("covered") != F.col("frame_count"), F.lit(None), "scene_coverage", "warning",
        F.concat_ws("/", "covered", "frame_count"),
    )


def _total(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda acc, v: acc + v)


def lum_hist_rules() -> list[tuple]:
    length, total = F.size("lum_hist"), _total("lum_hist")
    return [
        (length != 256, "frame_idx", "lum_hist_length", "error", length),
        ((length == 256) & (F.abs(total - 100.0) > 1.0), "frame_idx", "lum_hist_sum", "error", F.format_string("%.2f", total)),
    ]


def check_lum_hist(frames: DataFrame) -> DataFrame:
    return violations(frames, *lum_hist_rules())


def hue_hist_rules() -> list[tuple]:
    has, length, total = F.col("hue_hist").isNotNull(), F.size("hue_hist"), _total("hue_hist")
    return [
        (has & (length != 31), "frame_idx", "hue_hist_length", "warning", length),
        (has & (length == 31) & (total > 100.5), "frame_idx", "hue_hist_sum", "warning", F.format_string("%.2f", total)),
    ]


def check_hue_hist(frames: DataFrame) -> DataFrame:
    return violations(frames, *hue_hist_rules())


def hue_coverage(frames: DataFrame) -> DataFrame:
    """Frames with a hue histogram, frames where it is not empty, and the low-coverage warning."""
    has = F.col("hue_hist").isNotNull()
    colored = has & (F.size("hue_hist") == 31) & F.exists("hue_hist", lambda v: v > 0.01)
    counted = frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(F.when(has, 1)).alias("with_hue"),
        F.count(F.when(colored, 1)).alias("with_color"),
    )
    pct = F.when(F.col("with_hue") > 0, F.col("with_color") / F.col("with_hue") * 100.0)
    low = F.coalesce((pct < 50.0) & (F.col("with_hue") == F.col("frames")), F.lit(False))
    return counted.withColumn("pct", pct).withColumn("warn", low)


def pq_range_rules() -> list[tuple]:
    def outside(column: str) -> Column:
        return (F.col(column) < 0.0) | (F.col(column) > 1.0)

    return [
        (outside("peak_pq"), "frame_idx", "peak_pq_range", "error", F.format_string("%.4f", "peak_pq")),
        (~outside("peak_pq") & outside("avg_pq"), "frame_idx", "avg_pq_range", "error", F.format_string("%.4f", "avg_pq")),
    ]


def check_pq_range(frames: DataFrame) -> DataFrame:
    return violations(frames, *pq_range_rules())


def check_frames(frames: DataFrame) -> DataFrame:
    """All rules on single frames in one pass: both histograms and the range of peak and average."""
    return violations(frames, *lum_hist_rules(), *hue_hist_rules(), *pq_range_rules())


def check_fall(headers: DataFrame, frames: DataFrame) -> DataFrame:
    """Header MaxFALL and AvgFALL against the unrounded values derived from the frames."""
    derived = (
        frames.select("clip_id", c_pq_to_nits("avg_pq").alias("_nits"))
        .groupBy("clip_id")
        .agg(F.max("_nits").alias("_max"), F.avg("_nits").alias("_avg"))
    )
    joined = headers.join(derived, "clip_id")

    def off(header: str, value: str) -> Column:
        slack = F.greatest(F.lit(FALL_FLOOR_NITS), F.col(value) * F.lit(FALL_SHARE))
        return F.abs(F.col(value) - F.col(header)) > slack

    def detail(header: str, value: str) -> Column:
        return F.format_string("header=%d derived=%.0f", F.col(header), F.col(value))

    return violations(
        joined,
        (off("maxfall", "_max"), F.lit(None), "maxfall", "warning", detail("maxfall", "_max")),
        (off("avgfall", "_avg"), F.lit(None), "avgfall", "warning", detail("avgfall", "_avg")),
    )


def check_flags(headers: DataFrame, frames: DataFrame) -> DataFrame:
    """The optimizer flag promises a target on every frame, its absence promises none."""
    counts = frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count("target_nits").alias("_with")
    )
    joined = headers.join(counts, "clip_id")
    flagged = F.col("flags") == 3
    detail = F.concat_ws("/", "_with", "_all")
    return violations(
        joined,
        (flagged & (F.col("_with") < F.col("_all")), F.lit(None), "targets_missing", "warning", detail),
        (~flagged & (F.col("_with") > 0), F.lit(None), "targets_unexpected", "warning", detail),
    )


L6_POSITIVE = ("max_display_mastering_luminance", "max_content_light_level", "max_frame_average_light_level")


def block_of(level: str, version: str) -> Column:
    """First metadata block of a level in the exported document, else null."""
    blocks = F.col(f"doc.vdr_dm_data.{version}_metadata.ext_metadata_blocks")
    return F.get(F.filter(blocks, lambda b: b[level].isNotNull()), 0)[level]


def check_metadata(exported: DataFrame, cm_version: str | None = "V40") -> DataFrame:
    """Invariants of the generated metadata. ``exported`` has ``doc`` (see schemas.EXPORTED)."""
    rows = exported.select(
        "clip_id",
        F.col("doc.dovi_profile").alias("profile"),
        block_of("Level1", "cmv29").alias("l1"),
        block_of("Level6", "cmv29").alias("l6"),
        block_of("Level9", "cmv40").alias("l9"),
        block_of("Level11", "cmv40").alias("l11"),
        block_of("Level254", "cmv40").alias("l254"),
    )
    nothing = F.lit(None)

    def broken(condition: Column, rule: str) -> tuple:
        return condition, nothing, rule, "error", F.lit("")

    ordered = (F.col("l1.min_pq") <= F.col("l1.avg_pq")) & (F.col("l1.avg_pq") <= F.col("l1.max_pq"))
    parts = [
        broken(F.coalesce(F.col("profile") != 8, F.lit(True)), "profile"),
        broken(F.col("l1").isNull(), "l1_missing"),
        broken(F.col("l1").isNotNull() & ~F.coalesce(ordered, F.lit(False)), "l1_order"),
        broken(F.col("l6").isNull(), "l6_missing"),
        broken(
            F.col("l6").isNotNull() & F.col("l6.min_display_mastering_luminance").isNull(),
            "l6_min_display_mastering_luminance",
        ),
    ]
    for field in L6_POSITIVE:
        positive = F.coalesce(F.col(f"l6.{field}") > 0, F.lit(False))
        parts.append(broken(F.col("l6").isNotNull() & ~positive, f"l6_{field}"))
    if cm_version == "V40":
        parts += [
            broken(F.col("l9").isNull(), "l9_missing"),
            broken(F.col("l11").isNull(), "l11_missing"),
            broken(~F.coalesce(F.col("l254.dm_version_index") == 2, F.lit(False)), "l254_version"),
        ]
    return violations(rows, *parts)


def check_duration(source: DataFrame, output: DataFrame, tolerance: float = 1.0) -> DataFrame:
    pairs = source.select("clip_id", F.col("duration_s").alias("_in")).join(
        output.select("clip_id", F.col("duration_s").alias("_out")), "clip_id"
    )
    return violation(
        pairs, F.abs(F.col("_in") - F.col("_out")) > tolerance, F.lit(None), "duration", "error",
        F.format_string("%.2f/%.2f", F.col("_in"), F.col("_out")),
    )


def check_counts(frames: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Sidecar series lengths against the frame count. ``sidecar`` has the three arrays in ``frames``."""
    joined = sidecar.select(
        "clip_id",
        *[F.size(f"frames.{c}").alias(c) for c in ("min_pq_12bit", "avg_luma_pq_12bit", "avg_max_rgb_pq_12bit")],
    ).join(frame_counts(frames), "clip_id")
    return violations(joined, *[
        (F.col(c) != F.col("frame_count"), F.lit(None), f"sidecar_{c}", "error", F.concat_ws("/", c, "frame_count"))
        for c in ("min_pq_12bit", "avg_luma_pq_12bit", "avg_max_rgb_pq_12bit")
    ])


def check_domains(max_rgb: DataFrame, luma: DataFrame) -> DataFrame:
    """Max-RGB peaks lie at or above luma peaks; a run has scenes; its bias stays small."""
    pairs = max_rgb.select("clip_id", "frame_idx", "peak_pq", "scene_id").join(
        luma.select("clip_id", "frame_idx", F.col("peak_pq").alias("luma_peak_pq")), ["clip_id", "frame_idx"]
    )
    below = F.col("peak_pq") < F.col("luma_peak_pq") - F.lit(DOMAIN_SLACK)
    few = pairs.groupBy("clip_id").agg(F.max("scene_id").alias("_last"), F.min("scene_id").alias("_first"))
    return all_violations(
        violation(pairs, below, "frame_idx", "domain_order", "error", F.lit("")),
        violation(few, F.col("_last") == F.col("_first"), F.lit(None), "single_scene", "error", F.lit("")),
    )


def check_bias(stats: DataFrame, limit: float = MAX_BIAS_CODES) -> DataFrame:
    """``stats`` comes from ``scoring.error_stats``."""
    return violation(
        stats, F.abs(F.col("bias")) > limit, F.lit(None), "bias", "error", F.format_string("%.1f", "bias")
    )


def check_shots(starts: DataFrame, counts: DataFrame) -> DataFrame:
    """Rules of a shot list. ``starts`` has (clip_id, line, start), lines numbered from 0.

    A last line equal to the frame count is a sentinel and carries no rule.
    """
    ends = starts.groupBy("clip_id").agg(F.max("line").alias("_last"))
    listed = starts.join(ends, "clip_id").join(counts.select("clip_id", "frame_count"), "clip_id")
    shots = listed.where(~((F.col("line") == F.col("_last")) & (F.col("start") == F.col("frame_count"))))
    linked = previous_row(shots, ["clip_id"], "line", {"start": "_before"})
    kept = shots.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_n"), F.max("line").alias("_final"))
    all_clips = counts.select("clip_id").join(kept, "clip_id", "left")
    final = shots.join(kept.select("clip_id", "_final"), "clip_id").where(F.col("line") == F.col("_final"))
    text = F.col("start").cast("string")
    return all_violations(
        violation(all_clips, F.col("_n").isNull(), F.lit(None), "shots_empty", "error", F.lit("")),
        violations(
            linked,
            ((F.col("line") == 0) & (F.col("start") != 0), "line", "shots_first", "error", text),
            (F.col("_before") >= F.col("start"), "line", "shots_order", "error", text),
        ),
        violation(final, F.col("start") >= F.col("frame_count"), "line", "shots_outside", "error", text),
    )
