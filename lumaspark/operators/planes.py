"""The pixel pass on stored planes: map-only, no pixel is shuffled.

A planes row is a frame or a strip of full-width rows of a frame (``row0`` is the
first luma row of the strip, even, 0 where the column is absent). Each row is reduced
to bin counts where it is read; what leaves a task are the same rows that
``measure.pixel_stats`` gives after its partial aggregation, at most 256 + 4096 + 31 per strip, so
``measure.assemble`` and all estimators follow unchanged. Strips keep a row small
however large the frame is.

A frame may be known in part: a word of ``HOLE``, which no 10-bit code has, stands where there is no sample. Holes are
counted nowhere; a sample without its chroma site fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import estimators as E
from ..functions import transfer as T
from . import measure
from .samples import FRAME

STATS = (
    "clip_id STRING, frame_idx INT, lum_bin INT, fine_bin INT, hue_bin INT, n BIGINT, "
    "luma_sum DOUBLE, rgb_sum DOUBLE, luma_max DOUBLE, rgb_max DOUBLE, peak_max DOUBLE"
)
DIFFS = "clip_id STRING, frame_idx INT, band INT, diff INT, n BIGINT"
FINE_TOP = float(T.FINE_BINS - 1)
CODE_STEP = FINE_TOP / T.LUMA_RANGE  # fine bins per luma code
HOLE = 0xFFFF  # the word of a place without a sample
SAMPLES_AT_ONCE = 1 << 16  # per step, so that the working set stays in cache


def _tables(transfer: str, hlg_peak: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signal, luma and luma bin of the 1024 codes, from the same formulas as the column functions."""
    signal = (np.arange(1024) - T.BLACK_CODE) / T.LUMA_RANGE
    luma = np.clip(signal, 0.0, 1.0)
    if transfer == "HLG":
        relative = np.where(luma <= 0.5, luma * luma / 3.0, (np.exp((luma - T.HLG_C) / T.HLG_A) + T.HLG_B) / 12.0)
        nits = np.minimum(relative * hlg_peak, T.PEAK_NITS)
        y = (nits / T.PEAK_NITS) ** T.M1
        luma = np.clip(((T.C1 + T.C2 * y) / (1.0 + T.C3 * y)) ** T.M2, 0.0, 1.0)
    high_step = (1.0 - T.SDR_PEAK_PQ) / (T.LUM_BINS - T.SDR_BINS)
    bins = np.where(
        luma < T.SDR_PEAK_PQ, np.floor(luma / T.sdr_step()), T.SDR_BINS + np.floor((luma - T.SDR_PEAK_PQ) / high_step)
    )
    return signal, luma, np.minimum(bins, T.LUM_BINS - 1).astype(np.int64)


def _hue_table() -> np.ndarray:
    """Hue sector by (cb, cr), -1 where the chroma is weak."""
    u = (np.arange(1024) - T.NEUTRAL_CHROMA).astype(float)
    cb, cr = np.meshgrid(u, u, indexing="ij")
    degrees = (np.degrees(np.arctan2(cr, cb)) + 360.0) % 360.0
    sector = np.minimum(np.floor(degrees * T.HUE_BINS / 360.0), T.HUE_BINS - 1)
    return np.where(np.sqrt(cb * cb + cr * cr) >= T.MIN_CHROMA_MAGNITUDE, sector, -1).astype(np.int8)


def chroma_lift(cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """What the largest component adds to luma at a chroma site.

    All three components are luma plus a term of the chroma alone, so the largest term
    decides once per site instead of once per sample.
    """
    b, r = (cb - 512.0) / T.CHROMA_RANGE, (cr - 512.0) / T.CHROMA_RANGE
    red, blue = 1.4746 * r, 1.8814 * b
    green = -(0.2627 * red + 0.0593 * blue) / 0.6780
    return np.maximum(np.maximum(red, blue), green)


def _fine(pq: np.ndarray) -> np.ndarray:
    return (pq * (T.FINE_BINS - 1) + 0.5).astype(np.int64)


def codes_of(plane) -> np.ndarray:
    """Codes of a plane, packed words or an array."""
    if isinstance(plane, (bytes, bytearray, memoryview)):
        return np.frombuffer(plane, dtype="<u2")
    return np.asarray(plane)


def there(codes: np.ndarray) -> np.ndarray | None:
    """Which places have a sample; None if all have."""
    return codes != HOLE if codes.max(initial=0) == HOLE else None


def _pairs(code: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each site of a row after the first and the nearest one before it."""
    if known is None:
        return code[:, :-1], code[:, 1:]
    row, _ = np.nonzero(known)
    flat, same = code[known], row[1:] == row[:-1]
    return flat[:-1][same], flat[1:][same]


class _Strip:
    """One planes row cut to its crop."""

    def __init__(self, row, rect) -> None:
        width = int(row.width)
        self.luma = codes_of(row.luma).reshape(-1, width)
        self.cb, self.cr = (codes_of(p).reshape(-1, (width + 1) // 2) for p in (row.cb, row.cr))
        row0 = int(getattr(row, "row0", 0))
        self.known = there(self.luma)
        self.known_sites = there(self.cb)
        if self.known_sites is not None:
            sites = np.repeat(np.repeat(self.known_sites, 2, axis=0), 2, axis=1)[:len(self.luma), :width]
            if (~sites if self.known is None else self.known & ~sites).any():
                raise ValueError(f"clip {row.clip_id} frame {row.frame_idx}: a sample has no chroma site")
        x, y, w, h = rect if rect is not None else (0, 0, width, row0 + len(self.luma))
        self.left, self.right = x, min(x + w, width)
        self.top, self.bottom = max(y - row0, 0), min(y + h - row0, len(self.luma))
        # Hue sites floor at both ends of the crop.
        self.sites = (
            slice(max(y // 2 - row0 // 2, 0), max(y // 2 + h // 2 - row0 // 2, 0)), slice(x // 2, x // 2 + w // 2)
        )

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Luma codes and the lift of their sites, a few rows at a time."""
        rows_at_once = max(SAMPLES_AT_ONCE // self.luma.shape[1] // 2 * 2, 2)
        for first in range(self.top - self.top % 2, self.bottom, rows_at_once):
            low, high = max(first, self.top), min(first + rows_at_once, self.bottom)
            codes = self.luma[low:high, self.left:self.right]
            rows = slice(low // 2, (high + 1) // 2)
            lift = chroma_lift(self.cb[rows], self.cr[rows])
            wide = np.repeat(lift, 2, axis=1)[:, self.left:self.right]
            yield codes, np.repeat(wide, 2, axis=0)[low % 2:low % 2 + high - low]


def plane_stats(
    planes: DataFrame, transfer: str = "PQ", hlg_peak: float = T.DEFAULT_HLG_PEAK, domain: str = "max-rgb",
    crops: DataFrame | None = None,
) -> DataFrame:
    """Rows of ``measure.pixel_stats`` from planes."""
    hlg = transfer == "HLG"
    in_luma = hlg or domain == "luma"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _signal, luma, lum_bins = _tables(transfer, hlg_peak)
        hues = _hue_table()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                strip = _Strip(row, getattr(row, "rect", None))
                codes = np.zeros(1024, dtype=np.int64)
                fine = np.zeros(T.FINE_BINS, dtype=np.int64)
                rgb_sum, rgb_max = 0.0, 0.0
                for y, lift in strip.steps():
                    if strip.known is not None:
                        known = y != HOLE
                        y, lift = y[known], lift[known]
                    codes += np.bincount(y.ravel(), minlength=1024)
                    if not hlg:
                        # In units of a fine bin, so that the bin is one addition away.
                        rgb = y * CODE_STEP
                        rgb += lift * FINE_TOP - T.BLACK_CODE * CODE_STEP
                        np.clip(rgb, 0.0, FINE_TOP, out=rgb)
                        rgb_sum += float(rgb.sum()) / FINE_TOP
                        rgb_max = max(rgb_max, float(rgb.max(initial=0.0)) / FINE_TOP)
                        if not in_luma:
                            rgb += 0.5
                            fine += np.bincount(rgb.astype(np.intp).ravel(), minlength=T.FINE_BINS)
                used = np.flatnonzero(codes)
                n = int(codes.sum())
                if n == 0:
                    continue
                luma_sum, luma_max = float(codes @ luma), float(luma[used].max())
                if hlg:
                    rgb_sum, rgb_max = luma_sum, luma_max
                if in_luma:
                    np.add.at(fine, _fine(luma[used]), codes[used])
                by_bin = np.bincount(lum_bins, weights=codes, minlength=T.LUM_BINS).astype(np.int64)
                cb, cr = strip.cb[strip.sites], strip.cr[strip.sites]
                if strip.known_sites is not None:
                    known = strip.known_sites[strip.sites]
                    cb, cr = cb[known], cr[known]
                sector = hues[cb, cr]
                hue = np.bincount(sector[sector >= 0].ravel(), minlength=T.HUE_BINS)
                counts = (by_bin, fine, hue)
                bins = [np.flatnonzero(c) for c in counts]
                kind = np.repeat(np.arange(3), [len(b) for b in bins])
                every = np.concatenate(bins).astype(np.int32)
                slots = {
                    name: pd.arrays.IntegerArray(every, kind != i) for i, name in enumerate(("lum_bin", "fine_bin", "hue_bin"))
                }
                # Sums belong to the frame: they ride on the first luma row, the rest adds nothing.
                first = (np.arange(len(every)) == 0).astype(float)
                out = pd.DataFrame({
                    "clip_id": row.clip_id, "frame_idx": row.frame_idx, **slots,
                    "n": np.concatenate([c[b] for c, b in zip(counts, bins)]),
                    "luma_sum": first * luma_sum, "rgb_sum": first * rgb_sum, "luma_max": luma_max, "rgb_max": rgb_max,
                    "peak_max": luma_max if in_luma else rgb_max,
                })
                yield out

    stats = _with_rects(planes, crops).mapInPandas(reduce, STATS)
    if "row0" not in planes.columns:
        return stats
    # Strips of a frame share bins: add them up, on the map side first.
    sums = [F.sum(c).alias(c) for c in ("n", "luma_sum", "rgb_sum")]
    tops = [F.max(c).alias(c) for c in ("luma_max", "rgb_max", "peak_max")]
    return stats.groupBy(*FRAME, "lum_bin", "fine_bin", "hue_bin").agg(*sums, *tops)


def _with_rects(planes: DataFrame, crops: DataFrame | None) -> DataFrame:
    if crops is None:
        return planes
    rect = F.array("rect.x", "rect.y", "rect.width", "rect.height")
    rect = F.when(F.col("rect").isNotNull(), rect)
    return planes.join(crops.select("clip_id", rect.alias("rect")), "clip_id", "left")


def plane_diffs(planes: DataFrame, domain: str = "max-rgb", crops: DataFrame | None = None) -> DataFrame:
    """``grain.diff_histogram`` from planes: the row before is in the same array."""
    in_luma = domain == "luma"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signal, luma, _ = _tables("PQ", T.DEFAULT_HLG_PEAK)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                strip = _Strip(row, getattr(row, "rect", None))
                # First column of each site: even columns, and the left edge where it is odd.
                columns = np.arange(strip.left + strip.left % 2, strip.right, 2) - strip.left
                if strip.left % 2:
                    columns = np.concatenate(([0], columns))
                counts = np.zeros(E.DIFF_BANDS * E.DIFF_BINS, dtype=np.int64)
                for y, lift in strip.steps():
                    sites = y[:, columns]
                    known = None if strip.known is None else sites != HOLE
                    if known is not None:
                        sites = np.where(known, sites, 0)
                    code = _fine(luma[sites] if in_luma else np.clip(signal[sites] + lift[:, columns], 0.0, 1.0))
                    before, after = _pairs(code, known)
                    band = np.minimum(np.maximum(before, after) >> 8, E.DIFF_BANDS - 1)
                    diff = np.minimum(np.abs(after - before), E.DIFF_BINS - 1)
                    counts += np.bincount((band * E.DIFF_BINS + diff).ravel(), minlength=len(counts))
                used = np.flatnonzero(counts)
                yield pd.DataFrame({
                    "clip_id": row.clip_id, "frame_idx": row.frame_idx, "band": used // E.DIFF_BINS, "diff": used % E.DIFF_BINS, "n": counts[used],
                })

    parts = _with_rects(planes, crops).mapInPandas(reduce, DIFFS)
    return parts.groupBy(*FRAME, "band", "diff").agg(F.sum("n").alias("n"))


def measure_planes(
    planes: DataFrame,
    transfer: str = "PQ",
    hlg_peak: float = T.DEFAULT_HLG_PEAK,
    domain: str = "max-rgb",
    crops: DataFrame | None = None,
    min_percentile: float = measure.DEFAULT_MIN_PERCENTILE,
    peak_percentile: float = measure.DEFAULT_PEAK_PERCENTILE,
    estimator: str = "max",
) -> DataFrame:
    """``measure.measure_frames`` on planes."""
    stats = plane_stats(planes, transfer, hlg_peak, domain, crops)
    diffs = plane_diffs(planes, "luma" if transfer == "HLG" else domain, crops) if estimator == "robust" else None
    return measure.finish_frames(measure.assemble(stats, min_percentile), peak_percentile, estimator, diffs)


def median3_planes(planes: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """``grain.median3`` on stored frames: nine shifted views of the luma plane and the middle of each nine.

    Only the interior of the crop changes. Around holes it is the upper middle of the samples that are there. Rows must be whole frames; a strip lacks its neighbours' rows and fails.
    """
    given = _with_rects(planes, crops)
    names = planes.columns

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                luma = codes_of(row.luma).reshape(-1, int(row.width)).copy()
                if int(getattr(row, "row0", 0)) or len(luma) != int(row.height):
                    raise ValueError(f"clip {row.clip_id} frame {row.frame_idx}: the median needs whole frames")
                rect = getattr(row, "rect", None)
                x, y, w, h = rect if rect is not None else (0, 0, luma.shape[1], luma.shape[0])
                source, known = luma.copy(), there(luma)
                right, rows = x + w - 1, max(SAMPLES_AT_ONCE // max(luma.shape[1], 1), 1)
                for top in range(y + 1, y + h - 1, rows):
                    bottom = min(top + rows, y + h - 1)
                    if right - x < 2:
                        break
                    views = [source[top + dy:bottom + dy, x + 1 + dx:right + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
                    nine = np.stack(views)
                    if known is None:
                        luma[top:bottom, x + 1:right] = np.partition(nine, 4, axis=0)[4]
                        continue
                    # Holes sort last.
                    at = np.count_nonzero(nine != HOLE, axis=0) // 2
                    middle = np.take_along_axis(np.sort(nine, axis=0), at[None], axis=0)[0]
                    luma[top:bottom, x + 1:right] = np.where(nine[4] == HOLE, HOLE, middle)
                out.append(luma.astype("<u2").tobytes())
            yield pdf.assign(luma=out)[names]

    return given.mapInPandas(smooth, planes.schema)
