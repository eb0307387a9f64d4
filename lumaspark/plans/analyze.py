"""Samples or stored planes to frames, scenes, targets and headers: the whole measurement of a catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import grain, measure, planes as P, rollups, samples as S, scenes as SC, smoothing, targets
from ..session import staged


@dataclass(frozen=True)
class Options:
    """Options and their defaults."""

    version: int = 5
    transfer: str = "PQ"
    hlg_peak_nits: float = 1000.0
    domain: str = "max-rgb"
    peak_estimator: str = "max"
    peak_percentile: float = 99.99
    min_percentile: float = 0.1
    denoise: str = "off"
    stride: int = 1
    sample_rate: int = 1
    scene_metric: str = "hist"
    scene_threshold: float = 0.3
    min_scene_length: int = 24
    scene_smoothing: int = 5
    hist_ema_beta: float = 0.1
    hist_median: int = 0
    peak_source: str | None = None
    optimizer: bool = True
    profile: str = "balanced"
    target_smoother: str = "ema"
    smoother_alpha: float = 0.2
    smoother_two_way: bool = True
    target_peak_nits: int | None = None
    header_peak_source: str = "max"

    def __post_init__(self) -> None:
        for share in (self.peak_percentile, self.min_percentile):
            if not 0.0 <= share <= 100.0:
                raise ValueError("percentiles lie between 0 and 100")
        if self.hlg_peak_nits <= 0:
            raise ValueError("the HLG peak is positive")
        if self.denoise not in ("off", "median3"):
            raise ValueError(f"unknown denoise mode {self.denoise!r}")
        targets.profile_named(self.profile)


class Result:
    """Scenes and headers, and the frames with their targets: those are worked out when they are asked for."""

    def __init__(self, frames: Callable[[], DataFrame], scenes: DataFrame, headers: DataFrame) -> None:
        self._frames, self.scenes, self.headers = frames, scenes, headers

    @cached_property
    def frames(self) -> DataFrame:
        return self._frames()


def with_quality(name: str, options: Options) -> Options:
    stride, rate = S.QUALITY[name]
    return replace(options, stride=stride, sample_rate=rate)


def measure_samples(samples: DataFrame, crops: DataFrame | None, o: Options) -> DataFrame:
    """Pixel pass with the sampling, crop, denoise and estimator of the options."""
    chosen = S.every_nth_frame(samples, o.sample_rate)
    if crops is not None and o.denoise == "median3":
        chosen = grain.median3(chosen, crops)
    if crops is not None:
        if o.stride > 1:
            chosen = S.stride_samples(chosen, crops, o.stride)
        else:
            chosen = S.crop_samples(chosen, crops)
    domain = "luma" if o.transfer == "HLG" else o.domain
    diffs = None
    if o.peak_estimator == "robust":
        diffs = grain.diff_histogram(grain.cross_quad_diffs(chosen, crops, domain, o.transfer, o.hlg_peak_nits))
    return measure.measure_frames(
        chosen, o.transfer, o.hlg_peak_nits, domain, crops,
        o.min_percentile, o.peak_percentile, o.peak_estimator, diffs,
    ).drop("fine_entries", "n", "raw_max_pq")


def analyze_frames(measured: DataFrame, o: Options, all_frames: DataFrame | None = None) -> Result:
    """From measured frames to targets and headers.

    ``measured`` is read in several branches, so it should be a staged table. With
    sampling, ``all_frames`` names every frame and skipped ones take over the last measured.
    """
    cuts = SC.detect_cuts(
        measured, o.scene_threshold, o.min_scene_length, o.scene_smoothing, o.sample_rate, o.scene_metric
    )
    frames = measured
    if o.sample_rate > 1 and all_frames is not None:
        frames = SC.hold_analysed(all_frames, measured, o.sample_rate)
    framed = staged(SC.attach_scenes(frames.drop("scene_id"), cuts), "framed")
    smoothed = smoothing.smoothing_pass(
        framed, None, o.hist_ema_beta, o.hist_median, o.peak_source,
        "luma" if o.transfer == "HLG" else o.domain, o.profile,
    )
    smoothed = staged(smoothed, "smoothed")
    scenes = rollups.scene_stats(smoothed)
    headers = rollups.headers(
        smoothed, scenes, o.version, o.optimizer, o.target_peak_nits, o.header_peak_source
    )
    return Result(lambda: with_targets(smoothed, scenes, o), scenes, headers)


def with_targets(smoothed: DataFrame, scenes: DataFrame, o: Options) -> DataFrame:
    """The smoothed frames with the optimizer's targets."""
    final = smoothed
    if o.optimizer:
        final = targets.optimizer_pass(smoothed, scenes, o.profile)
        if o.target_smoother == "ema":
            # Targets are narrow: smooth them alone and join the histograms back once.
            narrow = staged(final.select("clip_id", "scene_id", "frame_idx", "target_nits"), "targets")
            better = targets.smooth_targets(
                smoothing.scene_position(narrow),
                min(max(o.smoother_alpha, 0.0), 1.0),
                o.smoother_two_way,
                targets.profile_named(o.profile).max_delta,
                bounds=targets.target_bounds(o.profile),
            )
            final = smoothed.drop("target_nits").join(
                better.select("clip_id", "frame_idx", "target_nits"), ["clip_id", "frame_idx"]
            )
    return final


def measure_stored(planes: DataFrame, crops: DataFrame | None, o: Options) -> DataFrame:
    """``measure_samples`` for stored planes: each row is reduced where it is read."""
    if S.effective_stride(o.stride) > 1:
        raise ValueError("a stride is for long samples; stored planes are measured whole")
    chosen = S.every_nth_frame(planes, o.sample_rate)
    if o.denoise == "median3":
        chosen = P.median3_planes(chosen, crops)
    domain = "luma" if o.transfer == "HLG" else o.domain
    return P.measure_planes(
        chosen, o.transfer, o.hlg_peak_nits, domain, crops, o.min_percentile, o.peak_percentile, o.peak_estimator,
    ).drop("fine_entries", "n", "raw_max_pq")


def analyze(samples: DataFrame, crops: DataFrame | None = None, options: Options | None = None) -> Result:
    """The whole measurement of long samples or stored planes. The frame table is staged once, so the input is scanned
    once. A clip without a crop is measured whole."""
    o = options or Options()
    pixel_pass = measure_stored if "luma" in samples.columns else measure_samples
    measured = staged(pixel_pass(samples, crops, o), "frames")
    every = samples.select("clip_id", "frame_idx").distinct() if o.sample_rate > 1 else None
    return analyze_frames(measured, o, every)
