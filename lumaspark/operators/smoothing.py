"""Temporal smoothing of histograms and averages inside scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import estimators as E
from ..functions import transfer as T
from ..session import staged
from .ordered import CHUNK, ema, fold_carries, halo_window, with_rank
from .samples import FRAME

DEFAULT_BETA = 0.1
SETTLED = 1e-9  # percent of a histogram
SCENE = ["clip_id", "scene_id"]


def scene_position(framed: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """Add ``scene_pos``, the number of the row inside its scene: dense also where frames are missing.

    ``scenes`` is kept for callers that have the bounds; the rows are counted.
    """
    return with_rank(framed, SCENE, "frame_idx", "scene_pos").withColumn("scene_pos", F.col("scene_pos").cast("int"))


def smooth_average(
    framed: DataFrame,
    columns: list[str],
    beta: float = DEFAULT_BETA,
    window: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """EMA that starts at the first value of the scene, then the upper median of the last
    ``window`` averages. ``framed`` has ``scene_pos``; the columns are replaced."""
    out = framed
    if beta > 0.0:
        out = ema(out, SCENE, "scene_pos", {c: f"_s_{c}" for c in columns}, beta, "first", chunk)
        out = out.drop(*columns).withColumnsRenamed({f"_s_{c}": c for c in columns})
    if window > 0:
        def upper_median(name: str):
            def build(w):
                last = F.sort_array(F.collect_list(name).over(w.rowsBetween(-(window - 1), 0)))
                return F.get(last, F.floor(F.size(last) / 2).cast("int"))
            return build

        out = halo_window(
            out, SCENE, "scene_pos", window - 1, {f"_m_{c}": upper_median(c) for c in columns}, chunk
        )
        out = out.drop(*columns).withColumnsRenamed({f"_m_{c}": c for c in columns})
    return out


def ema_histogram(hist: DataFrame, beta: float = DEFAULT_BETA, chunk: int = CHUNK) -> DataFrame:
    """Zero-start EMA of every bin inside the scene, each output row scaled back to 100 percent.

    ``hist`` has clip_id, scene_id, frame_idx, scene_pos and ``lum_hist``. The average of a
    chunk starts from nothing and the part from earlier chunks is added, scaled by
    its age: averages are linear, so chunks are independent tasks however long a
    scene is. The state is not rescaled, only the output.
    """
    if not 0.0 < beta <= 1.0:
        return hist
    keep = 1.0 - beta
    keys = [*SCENE, "_chunk"]
    chunked = hist.withColumn("_chunk", F.floor(F.col("scene_pos") / chunk).cast("bigint"))
    fields = [f for f in chunked.schema.fields if f.name != "lum_hist"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lum_hist array<double>"

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scene_pos")
        state = np.zeros(T.LUM_BINS)
        out = []
        for row in pdf["lum_hist"]:
            state = beta * np.asarray(row) + keep * state
            out.append(state)
        return pdf.assign(lum_hist=out)[[f.name for f in fields] + ["lum_hist"]]

    local = chunked.groupBy(*keys).applyInPandas(average, schema)
    if keep == 0.0:
        return rescale(local.drop("_chunk"))
    ends = local.where(F.col("scene_pos") % chunk == chunk - 1).select(*SCENE, "_chunk", "lum_hist")
    carry = fold_carries(ends, SCENE, ["lum_hist"], keep**chunk).withColumnRenamed("lum_hist_in", "_in")
    decay = F.pow(F.lit(keep), F.col("scene_pos") % chunk + 1)
    added = F.when(
        F.col("_in").isNotNull(), F.zip_with("lum_hist", "_in", lambda a, b: a + b * decay)
    ).otherwise(F.col("lum_hist"))
    return rescale(local.join(carry, keys, "left").withColumn("lum_hist", added).drop("_in", "_chunk"))


def rescale(df: DataFrame) -> DataFrame:
    """Scale ``lum_hist`` so that it sums to 100 where it sums to anything."""
    total = F.aggregate("lum_hist", F.lit(0.0), lambda acc, v: acc + v)
    scaled = E.let(total, lambda s: F.when(s > 0, F.transform("lum_hist", lambda v: v * (F.lit(100.0) / s))).otherwise(F.col("lum_hist")))
    return df.withColumn("lum_hist", scaled)


def recursive_median(rows: np.ndarray, history: list[np.ndarray], window: int) -> np.ndarray:
    """Each row becomes the median of itself and of the ``window - 1`` outputs before it, scaled to 100."""
    out = np.empty_like(rows)
    kept = np.empty((window, rows.shape[1]))
    held = list(history)[-(window - 1) :]
    for i, hist in enumerate(rows):
        n = len(held)
        if n:
            for k, h in enumerate(held):
                kept[k] = h
            kept[n] = hist
            ranked = np.sort(kept[: n + 1], axis=0)
            hist = (ranked[n // 2] + ranked[(n + 1) // 2]) / 2 if n % 2 else ranked[n // 2]
            total = hist.sum()
            if total > 0:
                hist = hist * (100.0 / total)
        out[i] = hist
        held.append(out[i])
        if n + 1 == window:
            held.pop(0)
    return out


def median_histogram(framed: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """Per-bin median of the current histogram and up to ``window - 1`` earlier outputs, rescaled.

    The filter feeds on its own output, so a value may depend on every earlier frame of the scene. Scenes are cut into chunks all the same: each first runs
    from the outputs at the end of the scene's first chunk, and then the state that a chunk began with is compared with what the chunk before it
    ended with. Only chunks that began with another state run again, from the right one. From three frames on
    the median stays between its own last outputs and soon stands still, so the first guess holds; with two it is an average that forgets, and one more run settles it.
    A scene that does neither is still right: every round settles at least one more of its chunks. States within ``SETTLED`` percent count as equal.

    The driver sees one emptiness test per round. ``window`` <= 1 changes nothing.
    """
    if window <= 1:
        return framed
    chunk = max(chunk, window)
    keys = [*SCENE, "_chunk"]
    names = framed.columns
    placed = staged(framed.withColumn("_chunk", F.floor(F.col("scene_pos") / chunk).cast("bigint")), "median-chunks")
    ends = f"{SCENE[0]} string, {SCENE[1]} {placed.schema[SCENE[1]].dataType.simpleString()}, _chunk bigint, _state array<array<double>>"

    def run(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows
        rows = rows.sort_values("scene_pos")
        history = [np.asarray(h, float) for h in entry["_state"].iloc[0]] if len(entry) else []
        return rows.assign(lum_hist=list(recursive_median(np.stack(rows["lum_hist"].to_numpy()).astype(float), history, window)))

    def runs(rows: DataFrame, entries: DataFrame, label: str) -> DataFrame:
        return staged(rows.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(run, placed.schema), label)

    def exits(done: DataFrame) -> DataFrame:
        """The last outputs of each whole chunk, as the state of the next."""
        last = done.where(F.col("scene_pos") % chunk >= chunk - window + 1)
        states = last.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("scene_pos", "lum_hist"))), lambda r: r["lum_hist"]).alias("_state"))
        return states.withColumn("_chunk", F.col("_chunk") + 1)

    spark = framed.sparkSession
    first = runs(placed.where("_chunk = 0"), spark.createDataFrame([], ends), "median-first")
    later = placed.where("_chunk > 0")
    begun = exits(first).drop("_chunk")
    entries = staged(later.select(*keys).distinct().join(begun, SCENE), "median-entries")
    if entries.isEmpty():
        return first.select(*names)
    done = first.unionByName(runs(later, entries, "median-guess"))
    while True:
        right = exits(done).withColumnRenamed("_state", "_right")
        far = F.exists(F.zip_with(F.flatten("_state"), F.flatten("_right"), lambda a, b: F.abs(a - b) > SETTLED), lambda x: x)
        wrong = staged(entries.join(right, keys).where(far).select(*keys, F.col("_right").alias("_state")), "median-wrong")
        if wrong.isEmpty():
            return done.select(*names)
        again = runs(later.join(wrong.select(*keys), keys, "left_semi"), wrong, "median-again")
        done = staged(done.join(wrong.select(*keys), keys, "left_anti").unionByName(again), "median-done")
        entries = staged(entries.join(wrong.select(*keys), keys, "left_anti").unionByName(wrong), "median-entries")


def default_peak_source(domain: str, profile: str) -> str:
    return "max" if domain == "max-rgb" or profile.lower() == "conservative" else "histogram99"


def select_peak(framed: DataFrame, source: str) -> DataFrame:
    """Replace ``peak_pq`` by the chosen source (histogram sources read ``lum_hist``)."""
    return framed.withColumn("peak_pq", E.select_peak_pq(F.col("lum_hist"), F.col("peak_pq"), source))


def smoothing_pass(
    framed: DataFrame,
    scenes: DataFrame | None = None,
    beta: float = DEFAULT_BETA,
    window: int = 0,
    peak_source: str | None = None,
    domain: str = "max-rgb",
    profile: str = "balanced",
    chunk: int = CHUNK,
) -> DataFrame:
    """Histogram EMA and median, peak source, smoothed averages, in this order.

    With both smoothings off the whole pass is skipped and the peak source with it.
    The minimum is never smoothed.
    """
    if beta <= 0.0 and window <= 0:
        return framed
    source = peak_source or default_peak_source(domain, profile)
    placed = scene_position(framed, scenes)
    hist = placed.select(*SCENE, "frame_idx", "scene_pos", "lum_hist")
    smoothed = ema_histogram(hist, beta, chunk) if beta > 0.0 else hist
    smoothed = median_histogram(smoothed, window, chunk) if window > 1 else smoothed
    averages = smooth_average(
        placed.drop("lum_hist"), ["avg_pq", "avg_max_rgb_pq"], beta, window, chunk
    )
    joined = averages.join(smoothed.select(*FRAME, "lum_hist"), FRAME)
    return select_peak(joined, source).drop("scene_pos").select(*framed.columns)
