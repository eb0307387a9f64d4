"""Live measurement, cuts, targets and totals.

Samples and frames carry the event time ``ts`` of their frame. State is kept per
frame (measurement), per clip (cuts, targets) or per clip (totals), and is dropped when the watermark
has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import transfer as T
from ..operators import measure
from ..operators.samples import FRAME

DEFAULT_DELAY = "10 seconds"


def live_measure(
    stream: DataFrame,
    delay: str = DEFAULT_DELAY,
    transfer="PQ",
    hlg_peak=T.DEFAULT_HLG_PEAK,
    domain: str = "max-rgb",
    min_percentile: float = measure.DEFAULT_MIN_PERCENTILE,
) -> DataFrame:
    """Frames as in the batch measurement, emitted once the watermark has passed them (append mode).

    Two chained aggregations: samples into bins per frame, bins into one row per frame.
    The first keeps at most 256 + 4096 + 31 rows of state per open frame.
    """
    leveled = measure.with_levels(stream.withWatermark("ts", delay), transfer, hlg_peak, domain)
    hue = T.hue_bin("cb_code", "cr_code")
    if "x" in stream.columns:
        hue = F.when((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0), hue)

    def kind(name: str, value):
        slots = {"lum_bin": F.lit(None), "fine_bin": F.lit(None), "hue_bin": F.lit(None), name: value}
        return F.struct(*[v.cast("int").alias(n) for n, v in slots.items()])

    kinds = F.array(
        kind("lum_bin", T.lum_bin("luma")), kind("fine_bin", T.fine_bin("peak")), kind("hue_bin", F.coalesce(hue, F.lit(-1)))
    )
    rows = leveled.select(*FRAME, "ts", "luma", "rgb", "peak", F.explode(kinds).alias("_k")).select(
        *FRAME, "ts", "luma", "rgb", "peak", "_k.*"
    )
    stats = rows.groupBy(*FRAME, "ts", "lum_bin", "fine_bin", "hue_bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("luma").alias("luma_sum"),
        F.sum("rgb").alias("rgb_sum"),
        F.max("peak").alias("peak_max"),
    )
    frames = measure.assemble(stats, min_percentile, [*FRAME, "ts"])
    return measure.finish_frames(frames, measure.DEFAULT_PEAK_PERCENTILE, "max")


OUTPUT = (
    "clip_id STRING, frame_idx INT, distance DOUBLE, smoothed DOUBLE, is_cut BOOLEAN, scene_id INT, "
    "held_from INT, target_nits INT, dropped BIGINT"
)
# What a clip carries from frame to frame. Waiting frames are entries of their own.
HEAD = "expected INT, dropped BIGINT, analysed INT, hist BINARY, recent ARRAY<DOUBLE>, last_cut INT, scene_id INT, target INT, held_target INT, waiting INT"
FRESH = (0, 0, None, None, [], 0, 0, None, None, 0)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sum((a - b) ** 2 / (a + b + 1e-6)))


class FrameOrder(StatefulProcessor):
    """Frames of a clip in order, with their distances, cuts and targets.

    Kept per clip: one narrow row (the head), and per waiting frame its event time and, apart from it, its histogram. A trigger
    writes the frames that came, deletes those that went and rewrites the head. Of the frames that wait on it reads the numbers and times only; their histograms stay
    where they are and are read once, when the frame's turn has come.
    """

    def __init__(self, threshold: float, min_len: int, smoothing: int, rate: int, max_delta: int):
        self.threshold, self.min_len, self.smoothing, self.rate, self.max_delta = threshold, min_len, smoothing, rate, max_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.stamps = handle.getMapState("stamps", "frame_idx INT", "ts BIGINT")
        self.frames = handle.getMapState("frames", "frame_idx INT", "hist BINARY, raw_target INT")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for pdf in rows:
            came = self._arrived(pdf)
            yield self._out(key, self._ready(came, timerValues.getCurrentWatermarkInMs()))
            for index, (stamp, hist, raw) in came.items():
                self.dropped += index in self.stored
                self.stored[index] = stamp
                self.stamps.updateValue((index,), (stamp,))
                self.frames.updateValue((index,), (hist.tobytes(), raw))
        self._save(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        yield self._out(key, self._ready({}, timerValues.getCurrentWatermarkInMs()))
        self._save(timerValues)

    def _load(self) -> None:
        head = self.head.get() if self.head.exists() else FRESH
        self.expected, self.dropped, self.analysed, hist, recent, self.last_cut, self.scene, self.target, self.held, waiting = head
        self.stored = {index: stamp for (index,), (stamp,) in self.stamps.iterator()} if waiting else {}
        self.hist = None if hist is None else np.frombuffer(bytes(hist), float)
        self.recent = list(recent)

    def _save(self, timerValues) -> None:
        hist = None if self.hist is None else self.hist.tobytes()
        self.head.update((self.expected, self.dropped, self.analysed, hist, self.recent, self.last_cut, self.scene, self.target, self.held, len(self.stored)))
        horizon = timerValues.getCurrentWatermarkInMs()
        if self.stored and horizon >= 0:
            self.handle.registerTimer(max(min(self.stored.values()), horizon + 1))

    def _arrived(self, pdf: pd.DataFrame) -> dict[int, tuple[int, np.ndarray, int | None]]:
        came: dict[int, tuple[int, np.ndarray, int | None]] = {}
        stamps = pd.to_datetime(pdf["ts"]).astype("datetime64[ms]").astype("int64")
        for index, stamp, values, raw in zip(pdf["frame_idx"], stamps, pdf["lum_hist"], pdf["raw_target"]):
            self.dropped += index < self.expected or index in came
            if index >= self.expected:
                came[int(index)] = (int(stamp), np.asarray(values, dtype=float), None if pd.isna(raw) else int(raw))
        return came

    def _ready(self, came: dict, horizon: int) -> Iterator[tuple]:
        """Takes the frames whose turn it is: the next one, or, once the watermark has passed it, the first one after a gap. What came is looked up before what waits."""
        queue = sorted({*came, *self.stored}, reverse=True)
        while queue:
            index = queue[-1]
            stamp = came[index][0] if index in came else self.stored[index]
            if index != self.expected and stamp > horizon:
                break
            queue.pop()
            if index in self.stored:
                if index in came:
                    self.dropped += 1
                else:
                    hist, raw = self.frames.getValue((index,))
                    came[index] = (stamp, np.frombuffer(bytes(hist), float), raw)
                del self.stored[index]
                self.stamps.removeKey((index,))
                self.frames.removeKey((index,))
            _, values, raw = came.pop(index)
            yield self._frame(index, values, raw)

    def _frame(self, index: int, values: np.ndarray, raw: int | None) -> tuple:
        self.expected = index + 1
        distance = smoothed = None
        cut = False
        if index % self.rate == 0 or self.analysed is None:
            if self.hist is not None:
                distance = _distance(values, self.hist)
                self.recent = [*self.recent, distance][-self.smoothing :] if self.smoothing > 0 else []
                smoothed = sum(self.recent) / len(self.recent) if self.recent else distance
                if smoothed > self.threshold and index - self.last_cut >= self.min_len:
                    cut, self.last_cut, self.scene = True, index, self.scene + 1
            self.hist, self.analysed, self.held = values, index, raw
        if self.held is not None:
            self.target = self.held if self.target is None else max(self.target - self.max_delta, min(self.target + self.max_delta, self.held))
        return index, distance, smoothed, cut, self.scene, self.analysed, self.target if self.held is not None else None, self.dropped

    @staticmethod
    def _out(key, rows: Iterator[tuple]) -> pd.DataFrame:
        columns = ["frame_idx", "distance", "smoothed", "is_cut", "scene_id", "held_from", "target_nits", "dropped"]
        out = pd.DataFrame(list(rows), columns=columns).astype(
            {"frame_idx": "int32", "distance": float, "smoothed": float, "is_cut": bool, "scene_id": "int32", "held_from": "Int32", "target_nits": "Int32", "dropped": "int64"}
        )
        out.insert(0, "clip_id", key[0])
        return out


def live_cuts_and_targets(
    stream: DataFrame,
    delay: str = DEFAULT_DELAY,
    threshold: float = 0.3,
    min_len: int = 24,
    smoothing: int = 5,
    rate: int = 1,
    max_delta: int = 200,
) -> DataFrame:
    """One row per frame in frame order: distance, cut, scene, held frame and limited target.

    ``stream`` has clip_id, frame_idx, ts, lum_hist and raw_target (nullable). Frames that arrive
    out of order wait in the clip's state until the frame before them has come; the
    state holds what arrived within the watermark delay. Once the watermark has passed a
    waiting frame, the frames missing before it can no longer come and are passed over; an event-time timer sees to it where nothing else comes.
    Rows later than the watermark are dropped and counted by the query's progress
    (``numRowsDroppedByWatermark``). Rows of frames that are already out or that were passed over are dropped as well;
    ``dropped`` is their number in the clip up to each row. Of several rows of a waiting frame the last counts and the others are dropped.

    Keyed state of this kind needs the RocksDB state store: it is set for the session here.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    order = FrameOrder(threshold, min_len, smoothing, rate, max_delta)
    wanted = stream.select(*FRAME, "ts", "lum_hist", "raw_target").withWatermark("ts", delay)
    return wanted.groupBy("clip_id").transformWithStateInPandas(order, OUTPUT, "append", "eventTime")


def live_cuts(stream: DataFrame, **options) -> DataFrame:
    """Accepted cuts as they are found (clip_id, frame_idx)."""
    return live_cuts_and_targets(stream, **options).where("is_cut").select(*FRAME)


def live_targets(stream: DataFrame, **options) -> DataFrame:
    """Limited targets per frame. The two-way smoother needs whole scenes, so live targets
    are forward only."""
    return live_cuts_and_targets(stream, **options).select(*FRAME, "scene_id", "held_from", "target_nits")


def live_totals(stream: DataFrame) -> DataFrame:
    """MaxCLL, MaxFALL and AvgFALL of every clip so far (update mode)."""
    nits = stream.select("clip_id", T.c_pq_to_nits("peak_pq").alias("_peak"), T.c_pq_to_nits("avg_pq").alias("_avg"))
    return nits.groupBy("clip_id").agg(
        F.max(F.round("_peak")).cast("int").alias("maxcll"),
        F.round(F.max("_avg")).cast("int").alias("maxfall"),
        F.round(F.avg("_avg")).cast("int").alias("avgfall"),
        F.count(F.lit(1)).alias("frame_count"),
    )
