"""Per-frame measurement: one pass over the samples, one row per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import estimators as E
from ..functions import transfer as T
from .samples import FRAME, hue_site_in_crop, weight

PEAK_ESTIMATORS = ("max", "percentile", "robust")
DEFAULT_PEAK_PERCENTILE = 99.99
DEFAULT_MIN_PERCENTILE = 0.1


def peak_domain(clips: DataFrame, requested: str | None = None) -> DataFrame:
    """HLG clips are always measured in luma; others as requested, by default max-RGB."""
    asked = requested or "max-rgb"
    if asked not in ("max-rgb", "luma"):
        raise ValueError(f"unknown peak domain {requested!r}")
    domain = F.when(F.col("transfer") == "HLG", "luma").otherwise(asked)
    return clips.select("clip_id", domain.alias("domain"))


def with_levels(samples: DataFrame, transfer="PQ", hlg_peak=T.DEFAULT_HLG_PEAK, domain="max-rgb") -> DataFrame:
    """Add ``luma``, ``rgb`` and ``peak`` per sample. ``transfer`` and ``domain`` are
    strings or columns; plain strings keep the expressions short."""
    leveled = samples.withColumn("luma", T.luma_pq("y_code", transfer, hlg_peak)).withColumn(
        "rgb", T.max_rgb_pq("y_code", "cb_code", "cr_code", transfer, hlg_peak)
    )
    if isinstance(domain, str):
        return leveled.withColumn("peak", F.col("luma" if domain == "luma" else "rgb"))
    return leveled.withColumn("peak", F.when(domain == "luma", F.col("luma")).otherwise(F.col("rgb")))


def code_counts(samples: DataFrame) -> DataFrame:
    """Exact pre-aggregate by code triple; mergeable by summing ``n``."""
    return samples.groupBy(*FRAME, "y_code", "cb_code", "cr_code").agg(
        F.sum(weight(samples)).cast("bigint").alias("n")
    )


def lum_histogram(samples: DataFrame, transfer="PQ", hlg_peak=T.DEFAULT_HLG_PEAK) -> DataFrame:
    """Counts by luma bin (long form)."""
    bin_ = T.lum_bin(T.luma_pq("y_code", transfer, hlg_peak))
    return samples.groupBy(*FRAME, bin_.alias("bin")).agg(F.sum(weight(samples)).cast("bigint").alias("n"))


def hue_histogram(samples: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """Counts by hue sector over chroma sites (long form).

    Samples without coordinates are taken as one chroma site each.
    """
    sites = samples
    if crops is not None:
        sites = sites.join(crops.select("clip_id", "rect"), "clip_id", "left").where(hue_site_in_crop(F.col("rect")))
    elif "x" in samples.columns:
        sites = sites.where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    return (
        sites.withColumn("bin", T.hue_bin("cb_code", "cr_code"))
        .where(F.col("bin").isNotNull())
        .groupBy(*FRAME, "bin")
        .agg(F.sum(weight(samples)).cast("bigint").alias("n"))
    )


def fine_histogram(samples: DataFrame, domain="max-rgb", transfer="PQ", hlg_peak=T.DEFAULT_HLG_PEAK) -> DataFrame:
    leveled = with_levels(samples, transfer, hlg_peak, domain)
    return leveled.groupBy(*FRAME, T.fine_bin("peak").alias("bin")).agg(
        F.sum(weight(samples)).cast("bigint").alias("n")
    )


def merge_histograms(*hists: DataFrame) -> DataFrame:
    """Sum of histograms that share their columns; the counts are in ``n``."""
    whole = hists[0]
    for hist in hists[1:]:
        whole = whole.unionByName(hist)
    keys = [c for c in whole.columns if c != "n"]
    return whole.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"))


def percents(hist: DataFrame) -> DataFrame:
    """Share of each bin in percent; the window spans one frame's bins."""
    total = F.sum("n").over(Window.partitionBy(*FRAME))
    return hist.withColumn("pct", F.col("n") / total * 100.0)


def frame_levels(samples: DataFrame, transfer="PQ", hlg_peak=T.DEFAULT_HLG_PEAK) -> DataFrame:
    leveled = with_levels(samples, transfer, hlg_peak)
    w = weight(samples)
    return leveled.groupBy(*FRAME).agg(
        F.max("luma").alias("max_luma"),
        F.max("rgb").alias("max_rgb"),
        F.least(F.sum(F.col("luma") * w) / F.sum(w), F.lit(1.0)).alias("avg_pq"),
        F.least(F.sum(F.col("rgb") * w) / F.sum(w), F.lit(1.0)).alias("avg_max_rgb_pq"),
        F.sum(w).cast("bigint").alias("n"),
    )


def as_entries(hist: DataFrame) -> DataFrame:
    """One sorted array of (bin, n) per frame; its length is bounded by the bin count."""
    return hist.groupBy(*FRAME).agg(
        F.sort_array(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), F.col("n").alias("n")))).alias("entries")
    )


def low_percentile(hist: DataFrame, p: float, bins: int = T.FINE_BINS) -> DataFrame:
    return as_entries(hist).select(*FRAME, E.low_percentile_pq(F.col("entries"), p, bins).alias("pq"))


def high_percentile(hist: DataFrame, p: float, bins: int = T.FINE_BINS) -> DataFrame:
    return as_entries(hist).select(*FRAME, E.high_percentile_pq(F.col("entries"), p, bins).alias("pq"))


def min_pq(hist: DataFrame, p: float = DEFAULT_MIN_PERCENTILE) -> DataFrame:
    return low_percentile(hist, p).withColumnRenamed("pq", "min_pq")


def dense(entries: Column, total: Column, bins: int) -> Column:
    """Dense percent histogram from sorted entries.

    The array is built by walking the entries once: zeros up to the next bin, then its share.
    """
    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<double>").alias("out"))

    def put(acc: Column, e: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0), e["bin"] - acc["next"])
        return F.struct(
            (e["bin"] + 1).alias("next"),
            F.concat(acc["out"], gap, F.array(e["n"] / total * 100.0)).alias("out"),
        )

    return F.aggregate(
        entries, begin, put, lambda acc: F.concat(acc["out"], F.array_repeat(F.lit(0.0), F.lit(bins) - acc["next"]))
    )


def pixel_stats(
    samples: DataFrame,
    transfer="PQ",
    hlg_peak=T.DEFAULT_HLG_PEAK,
    domain="max-rgb",
    crops: DataFrame | None = None,
) -> DataFrame:
    """All measures of the pixel pass in one scan and one shuffle.

    Grouping sets by luma bin, fine bin and hue sector leave at most 256 + 4096 + 32
    rows per frame and map task after the partial aggregation, however many pixels a
    frame has. Grouping by code triple would leave almost every pixel.
    """
    w = weight(samples)
    leveled = with_levels(samples, transfer, hlg_peak, domain)
    hue = T.hue_bin("cb_code", "cr_code")
    if crops is not None:
        leveled = leveled.join(crops.select("clip_id", "rect"), "clip_id", "left")
        hue = F.when(hue_site_in_crop(F.col("rect")), hue)
    elif "x" in samples.columns:
        hue = F.when((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0), hue)
    prepared = leveled.select(
        *FRAME,
        T.lum_bin("luma").alias("lum_bin"),
        T.fine_bin("peak").alias("fine_bin"),
        F.coalesce(hue, F.lit(-1)).alias("hue_bin"),
        w.cast("bigint").alias("n"),
        "luma",
        "rgb",
        "peak",
    )
    kinds = ["lum_bin", "fine_bin", "hue_bin"]
    return prepared.groupingSets([[*FRAME, kind] for kind in kinds], *FRAME, *kinds).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("luma") * F.col("n")).alias("luma_sum"),
        F.sum(F.col("rgb") * F.col("n")).alias("rgb_sum"),
        F.max("luma").alias("luma_max"),
        F.max("rgb").alias("rgb_max"),
        F.max("peak").alias("peak_max"),
    )


def measure_frames(
    samples: DataFrame,
    transfer="PQ",
    hlg_peak=T.DEFAULT_HLG_PEAK,
    domain="max-rgb",
    crops: DataFrame | None = None,
    min_percentile: float = DEFAULT_MIN_PERCENTILE,
    peak_percentile: float = DEFAULT_PEAK_PERCENTILE,
    estimator: str = "max",
    diffs: DataFrame | None = None,
) -> DataFrame:
    """Frames table: peak, averages, minimum, luma and hue histograms, fine entries.

    ``diffs`` (see ``grain.diff_histogram``) is needed by the robust estimator only.
    """
    if estimator not in PEAK_ESTIMATORS:
        raise ValueError(f"unknown peak estimator {estimator!r}")
    if not (0.0 <= min_percentile <= 100.0 and 0.0 <= peak_percentile <= 100.0):
        raise ValueError("percentiles lie between 0 and 100")
    stats = pixel_stats(samples, transfer, hlg_peak, domain, crops)
    return finish_frames(assemble(stats, min_percentile), peak_percentile, estimator, diffs)


def assemble(stats: DataFrame, min_percentile: float = DEFAULT_MIN_PERCENTILE, keys: list[str] = FRAME) -> DataFrame:
    """One row per frame from the rows of the pixel pass (bounded arrays of bins)."""

    def entries(kind: str) -> Column:
        pair = F.struct(F.col(kind).alias("bin"), F.col("n").alias("n"))
        return F.sort_array(F.collect_list(F.when(F.col(kind) >= 0, pair)))

    counted = F.col("lum_bin").isNotNull()
    frames = stats.groupBy(*keys).agg(
        F.sum(F.when(counted, F.col("n"))).alias("n"),
        F.sum(F.when(counted, F.col("luma_sum"))).alias("luma_sum"),
        F.sum(F.when(counted, F.col("rgb_sum"))).alias("rgb_sum"),
        F.max("peak_max").alias("raw_max_pq"),
        entries("lum_bin").alias("lum_entries"),
        entries("fine_bin").alias("fine_entries"),
        entries("hue_bin").alias("hue_entries"),
    )
    hue_total = E.total_count(F.col("hue_entries"))
    return frames.select(
        *keys,
        "n",
        "raw_max_pq",
        F.least(F.col("luma_sum") / F.col("n"), F.lit(1.0)).alias("avg_pq"),
        F.least(F.col("rgb_sum") / F.col("n"), F.lit(1.0)).alias("avg_max_rgb_pq"),
        E.low_percentile_pq(F.col("fine_entries"), min_percentile).alias("min_pq"),
        dense(F.col("lum_entries"), F.col("n"), T.LUM_BINS).alias("lum_hist"),
        E.let(hue_total, lambda total: dense(F.col("hue_entries"), total, T.HUE_BINS)).alias("hue_hist"),
        "fine_entries",
    )


def finish_frames(
    measured: DataFrame, peak_percentile: float, estimator: str, diffs: DataFrame | None = None
) -> DataFrame:
    """Add the estimator's peak and an empty target."""
    if estimator == "max":
        peak = F.col("raw_max_pq")
    elif estimator == "percentile":
        peak = E.high_percentile_pq(F.col("fine_entries"), peak_percentile)
    else:
        if diffs is None:
            raise ValueError("the robust estimator needs the difference histogram")
        measured = with_grain(measured, diffs)
        peak = E.robust_peak(F.col("fine_entries"), F.col("raw_max_pq"), F.col("sigma_pq"))
    return measured.withColumn("peak_pq", peak).withColumn("target_nits", F.lit(None).cast("int"))


def with_grain(frames: DataFrame, diffs: DataFrame) -> DataFrame:
    """Add ``sigma_pq`` from the difference histogram (at most 16 x 64 rows per frame)."""
    pair = F.struct(F.col("band").cast("int").alias("band"), F.col("diff").cast("int").alias("diff"), F.col("n"))
    pairs = diffs.groupBy(*FRAME).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    empty = F.array().cast("array<struct<band: int, diff: int, n: bigint>>")
    return (
        frames.join(pairs, FRAME, "left")
        .withColumn("pairs", F.coalesce("pairs", empty))
        .withColumn("sigma_pq", E.grain_sigma(F.col("pairs"), F.col("fine_entries")))
        .drop("pairs")
    )


def peak_stats(
    fine: DataFrame,
    raw: DataFrame,
    diffs: DataFrame,
    estimator: str = "max",
    percentile: float = DEFAULT_PEAK_PERCENTILE,
) -> DataFrame:
    """Peak diagnostics per frame. ``raw`` has ``raw_max_pq``."""
    if estimator not in PEAK_ESTIMATORS:
        raise ValueError(f"unknown peak estimator {estimator!r}")
    frames = as_entries(fine).withColumnRenamed("entries", "fine_entries").join(raw.select(*FRAME, "raw_max_pq"), FRAME)
    graded = with_grain(frames, diffs)
    entries, sigma, top = F.col("fine_entries"), F.col("sigma_pq"), F.col("raw_max_pq")
    stats = (
        graded.withColumn("percentile_pq", E.high_percentile_pq(entries, percentile))
        .withColumn("robust_pq", E.robust_peak(entries, top, sigma))
        .withColumn("n_eff", E.effective_tail(entries, top, sigma))
        .withColumn("correction_pq", top - F.col("robust_pq"))
    )
    chosen = {"max": "raw_max_pq", "percentile": "percentile_pq", "robust": "robust_pq"}[estimator]
    return stats.select(
        *FRAME,
        F.col(chosen).alias("selected_pq"),
        "raw_max_pq",
        "percentile_pq",
        "robust_pq",
        "sigma_pq",
        "correction_pq",
        "n_eff",
    )


def full_range_measure(samples: DataFrame) -> DataFrame:
    """The full-range luma variant: code / 1023 in 256 equal bins (long form with frame facts)."""
    w = weight(samples)
    facts = samples.groupBy(*FRAME).agg(
        (F.max("y_code") / F.lit(1023.0)).alias("peak_pq"),
        (F.sum(F.col("y_code") * w) / F.lit(1023.0) / F.sum(w)).alias("avg_pq"),
    )
    hist = samples.groupBy(*FRAME, T.full_range_bin("y_code").alias("bin")).agg(F.sum(w).cast("bigint").alias("n"))
    return percents(hist).join(facts, FRAME)
