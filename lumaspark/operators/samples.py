"""Choosing samples before they are measured: crop, stride, sampling, probes, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import GRID_STEP, MIN_USABLE_SHARE, rect
from ..functions.transfer import col, is_non_black
from .ordered import hold_last

FRAME = ["clip_id", "frame_idx"]
# Fixed quality presets: name to (spatial stride, frame sampling rate).
QUALITY = {"fast": (2, 3), "balanced": (2, 1), "auto": (2, 1), "accurate": (1, 1)}
PROBE_LIMIT = 120
TICKS_PER_CHUNK = 1 << 16
WINDOW_SECONDS = 20


def attach_crop(df: DataFrame, crops: DataFrame) -> DataFrame:
    """Add the clip's ``rect``, null for a clip without a crop: such a clip counts whole.

    The join is a plain equi join: the optimizer broadcasts ``crops`` only while its measured
    size stays under the session's threshold."""
    return df.join(crops.select("clip_id", "rect"), "clip_id", "left")


def attach_clip(df: DataFrame, clips: DataFrame, *columns: str) -> DataFrame:
    wanted = columns or ("width", "height", "transfer", "hlg_peak_nits")
    return df.join(clips.select("clip_id", *wanted), "clip_id")


def inside(x: Column, y: Column, rect: Column) -> Column:
    return rect.isNull() | (
        (x >= rect["x"]) & (x < rect["x"] + rect["width"])
        & (y >= rect["y"]) & (y < rect["y"] + rect["height"])
    )


def crop_samples(samples: DataFrame, crops: DataFrame) -> DataFrame:
    joined = attach_crop(samples, crops)
    return joined.where(inside(F.col("x"), F.col("y"), F.col("rect"))).drop("rect")


def complete_crops(samples: DataFrame, crops: DataFrame) -> DataFrame:
    """(clip_id, rect) with the extent of the stored samples for clips that have no crop."""
    whole = samples.join(crops, "clip_id", "left_anti").groupBy("clip_id").agg(F.max("x").alias("_x"), F.max("y").alias("_y"))
    return crops.select("clip_id", "rect").unionByName(whole.select("clip_id", rect(F.lit(0), F.lit(0), F.col("_x") + 1, F.col("_y") + 1).alias("rect")))


def hue_site_in_crop(rect: Column) -> Column:
    """True on the luma sample that stands for a chroma site of the hue histogram.

    Its bounds floor at both ends, unlike the pixel bounds of the crop.
    """
    cx, cy = F.floor(F.col("x") / 2), F.floor(F.col("y") / 2)
    left, top = F.floor(rect["x"] / 2), F.floor(rect["y"] / 2)
    bounded = (
        (cx >= left) & (cx < left + F.floor(rect["width"] / 2))
        & (cy >= top) & (cy < top + F.floor(rect["height"] / 2))
    )
    return (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0) & (rect.isNull() | bounded)


def every_nth_frame(df: DataFrame, rate: int) -> DataFrame:
    return df.where(F.col("frame_idx") % max(rate, 1) == 0)


def effective_stride(requested: int) -> int:
    return requested if requested in (1, 2, 4) else 1


def stride_samples(samples: DataFrame, crops: DataFrame, stride: int) -> DataFrame:
    """Every n-th sample in both directions, counted from the crop corner."""
    step = effective_stride(stride)
    joined = attach_crop(samples, crops)
    kept = inside(F.col("x"), F.col("y"), F.col("rect"))
    if step > 1:
        kept = (
            kept
            & ((F.col("x") - F.coalesce("rect.x", F.lit(0))) % step == 0)
            & ((F.col("y") - F.coalesce("rect.y", F.lit(0))) % step == 0)
        )
    return joined.where(kept).drop("rect")


def attach_chroma(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Give every luma sample the codes of its 4:2:0 chroma site (cx, cy)."""
    sited = luma.withColumn("cx", F.floor(F.col("x") / 2).cast("int")).withColumn(
        "cy", F.floor(F.col("y") / 2).cast("int")
    )
    return sited.join(chroma, [*FRAME, "cx", "cy"]).drop("cx", "cy")


def grid(samples: DataFrame) -> DataFrame:
    return samples.where((F.col("x") % GRID_STEP == 0) & (F.col("y") % GRID_STEP == 0))


def usable_share(samples: DataFrame) -> DataFrame:
    """Share of non-black samples on the coarse grid, per frame."""
    return grid(samples).groupBy(*FRAME).agg(
        F.avg(F.when(is_non_black("y_code"), 1.0).otherwise(0.0)).alias("share")
    )


def usable_frames(samples: DataFrame, min_fraction: float = MIN_USABLE_SHARE) -> DataFrame:
    return usable_share(samples).where(F.col("share") >= min_fraction).select(*FRAME)


def probe_ticks(clips: DataFrame, n: int = 7) -> DataFrame:
    """``n`` ticks spread over 15 % to 85 % of [start_tick, start_tick + duration]."""
    if n <= 0:
        return clips.select("clip_id", F.lit(0).alias("probe"), F.lit(0).cast("bigint").alias("tick")).where(F.lit(False))
    usable = clips.where(F.col("duration") > 0)
    if n == 1:
        offset = F.expr("duration div 2")
    else:
        # The product may leave 64 bits, so it is taken as a decimal.
        parts = n - 1
        product = F.col("duration").cast("decimal(20,0)") * (F.lit(15 * parts) + F.lit(70) * F.col("probe"))
        offset = F.floor(product / F.lit(100 * parts)).cast("bigint")
    return (
        usable.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select("clip_id", "probe", (F.col("start_tick") + offset).cast("bigint").alias("tick"))
    )


def first_usable_after(ticks: DataFrame, frames: DataFrame, limit: int = PROBE_LIMIT) -> DataFrame:
    """First usable frame within ``limit`` frames from the first frame at or after a tick.

    ``frames`` has ``pts`` and ``usable``. Ticks and frames are one series, walked backwards: each row takes over the
    nearest frame and the nearest usable frame behind it. No tick meets the frames of its clip one by one.
    """
    nothing = F.lit(None).cast("int")
    shown = frames.select(
        "clip_id", (-2 * F.col("pts")).cast("bigint").alias("_pos"), F.col("frame_idx").alias("first_frame"),
        F.when(F.col("usable"), F.col("frame_idx")).alias("frame_idx"), nothing.alias("probe"),
    )
    # A frame at the very tick counts, so the tick stands just after it on the way back.
    asked = ticks.select("clip_id", (1 - 2 * F.col("tick")).cast("bigint").alias("_pos"), nothing.alias("first_frame"), nothing.alias("frame_idx"), F.col("probe").cast("int").alias("probe"))
    held = hold_last(shown.unionByName(asked), ["clip_id"], "_pos", ["first_frame", "frame_idx"], TICKS_PER_CHUNK)
    return held.where(F.col("probe").isNotNull() & (F.col("frame_idx") - F.col("first_frame") < limit)).select("clip_id", "probe", "frame_idx")


def sample_windows(clips: DataFrame) -> DataFrame:
    """Offsets in seconds of the windows to look at."""
    d = F.col("duration_s")
    offsets = (
        F.when(d.isNull(), F.array(F.lit(60), F.lit(600), F.lit(1800)))
        .when(d >= 240.0, F.array(*[(d * share).cast("int") for share in (0.15, 0.45, 0.75)]))
        .otherwise(F.array(F.lit(0)))
    )
    return clips.select("clip_id", F.posexplode(offsets).alias("window", "offset_s"))


def frames_in_windows(frames: DataFrame, windows: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Frames whose ``time_s`` falls into a window; an equi join on the covered seconds."""
    span = windows.withColumn("_second", F.explode(F.sequence(F.col("offset_s"), F.col("offset_s") + seconds - 1)))
    timed = frames.withColumn("_second", F.floor("time_s").cast("int"))
    return timed.join(span.select("clip_id", "window", "_second"), ["clip_id", "_second"]).drop("_second")


def append_windows(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def skip_converted(catalog: DataFrame, repair: bool = False) -> DataFrame:
    return catalog if repair else catalog.where(~F.col("path").endswith(".DV.mkv"))


def skipped_count(catalog: DataFrame, repair: bool = False) -> DataFrame:
    converted = F.col("path").endswith(".DV.mkv") & F.lit(not repair)
    return catalog.agg(
        F.count(F.when(converted, 1)).alias("skipped"), F.count(F.when(~converted, 1)).alias("kept")
    )


def weight(df: DataFrame) -> Column:
    """Row weight: ``n`` where the samples are pre-counted, else one."""
    return col("n") if "n" in df.columns else F.lit(1)
