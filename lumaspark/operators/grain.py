"""Spatial neighbourhoods: 3x3 median and site-to-site differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import estimators as E
from ..functions import transfer as T
from .measure import as_entries, with_levels
from .samples import FRAME, complete_crops, crop_samples


def cross_quad_diffs(
    samples: DataFrame,
    crops: DataFrame | None = None,
    domain="max-rgb",
    transfer="PQ",
    hlg_peak=T.DEFAULT_HLG_PEAK,
) -> DataFrame:
    """Difference between the first sample of a chroma site and that of the site before it.

    The window spans one luma row of one frame. ``first_x`` is the crop's left edge:
    where it is odd, the first site starts on it.
    """
    if crops is None:
        placed = samples.withColumn("_left", F.lit(0))
    else:
        placed = crop_samples(samples, crops).join(
            crops.select("clip_id", F.col("rect.x").alias("_left")), "clip_id", "left"
        ).withColumn("_left", F.coalesce("_left", F.lit(0)))
    first = (F.col("x") == F.greatest(F.col("x") - F.col("x") % 2, F.col("_left")))
    sites = with_levels(placed.where(first), transfer, hlg_peak, domain).select(
        *FRAME, "y", "x", T.fine_bin("peak").alias("code")
    )
    row = Window.partitionBy(*FRAME, "y").orderBy("x")
    paired = sites.withColumn("before", F.lag("code").over(row)).where(F.col("before").isNotNull())
    return paired.select(
        *FRAME,
        "y",
        "x",
        F.least(F.shiftright(F.greatest("code", "before"), 8), F.lit(E.DIFF_BANDS - 1)).alias("band"),
        F.least(F.abs(F.col("code") - F.col("before")), F.lit(E.DIFF_BINS - 1)).alias("diff"),
    )


def diff_histogram(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy(*FRAME, "band", "diff").agg(F.count(F.lit(1)).alias("n"))


def grain_sigma(diff_hist: DataFrame, fine: DataFrame) -> DataFrame:
    from .measure import with_grain

    frames = as_entries(fine).withColumnRenamed("entries", "fine_entries")
    return with_grain(frames, diff_hist).select(*FRAME, "sigma_pq")


def effective_tail(fine: DataFrame, raw: DataFrame, sigma: DataFrame) -> DataFrame:
    joined = as_entries(fine).join(raw.select(*FRAME, "raw_max_pq"), FRAME).join(sigma, FRAME)
    return joined.select(
        *FRAME, E.effective_tail(F.col("entries"), F.col("raw_max_pq"), F.col("sigma_pq")).alias("n_eff")
    )


def robust_peak(fine: DataFrame, raw: DataFrame, sigma: DataFrame) -> DataFrame:
    joined = as_entries(fine).join(raw.select(*FRAME, "raw_max_pq"), FRAME).join(sigma, FRAME)
    return joined.select(
        *FRAME, E.robust_peak(F.col("entries"), F.col("raw_max_pq"), F.col("sigma_pq")).alias("robust_pq")
    )


def median3(samples: DataFrame, crops: DataFrame) -> DataFrame:
    """3x3 median of luma on the interior of the crop; every other sample stays as it is.

    Each sample is sent to the interior neighbours it belongs to, so the shuffle is
    nine rows per interior sample of three small integers. Where the neighbourhood
    reaches past the stored samples, the middle of those present is taken.
    """
    rect = F.col("rect")
    placed = samples.join(complete_crops(samples, crops), "clip_id")
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = (
        placed.withColumn("_s", F.explode(shifts))
        .select(
            *FRAME,
            (F.col("x") + F.col("_s.dx")).alias("x"),
            (F.col("y") + F.col("_s.dy")).alias("y"),
            "y_code",
            "rect",
        )
        .where(
            (F.col("x") > rect["x"]) & (F.col("x") < rect["x"] + rect["width"] - 1)
            & (F.col("y") > rect["y"]) & (F.col("y") < rect["y"] + rect["height"] - 1)
        )
    )
    middle = spread.groupBy(*FRAME, "x", "y").agg(F.sort_array(F.collect_list("y_code")).alias("_near"))
    median = middle.select(
        *FRAME, "x", "y", F.get("_near", F.floor(F.size("_near") / 2).cast("int")).alias("_median")
    )
    return (
        samples.join(median, [*FRAME, "x", "y"], "left")
        .withColumn("y_code", F.coalesce("_median", "y_code"))
        .drop("_median")
    )
