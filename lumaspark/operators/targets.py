"""Display targets per frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import estimators as E
from ..functions.transfer import c_pq_to_nits, clamp, pq_to_nits
from ..session import staged
from .ordered import CHUNK, ema, halo_window, limit_steps
from .samples import FRAME
from .smoothing import SCENE, scene_position

ROLLING_FRAMES = 240
DARK_BELOW, BRIGHT_FROM = 50.0, 150.0
DEFAULT_ALPHA = 0.2
DEFAULT_MAX_DELTA = 200


@dataclass(frozen=True)
class Profile:
    max_delta: int
    extreme_peak: int
    dark: tuple[int, int]
    medium: tuple[int, int]
    bright: tuple[int, int]
    dark_knee: float
    medium_knee: float
    bright_knee: float
    knee_window: int


# Fixed values of the three profiles.
PROFILES = {
    "conservative": Profile(100, 3500, (600, 1500), (500, 1200), (400, 900), 1.1, 1.05, 1.0, 10),
    "balanced": Profile(200, 4000, (800, 2000), (600, 1500), (400, 1000), 1.2, 1.1, 1.0, 5),
    "aggressive": Profile(300, 4500, (1000, 2500), (800, 2000), (500, 1200), 1.3, 1.15, 1.05, 3),
}


def profile_named(name: str) -> Profile:
    try:
        return PROFILES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown profile {name!r}; one of {', '.join(PROFILES)}") from None


def target_bounds(profile: str) -> tuple[int, int]:
    """Range of every raw target of a profile: no branch of the heuristic exceeds its largest limit."""
    p = profile_named(profile)
    return 0, max(p.extreme_peak, p.dark[1], p.medium[1], p.bright[1])


def rolling_apl(placed: DataFrame, scenes: DataFrame, n: int = ROLLING_FRAMES, chunk: int = CHUNK) -> DataFrame:
    """Add ``scene_apl_nits`` and ``apl_nits`` (0.6 rolling mean + 0.4 scene mean).

    ``placed`` has ``scene_pos`` and ``avg_pq``; ``scenes`` has the scene's ``avg_pq``.
    """
    means = scenes.select(*SCENE, pq_to_nits("avg_pq").alias("scene_apl_nits"))
    rolled = halo_window(
        placed, SCENE, "scene_pos", n - 1, {"_rolling": lambda w: F.avg("avg_pq").over(w.rowsBetween(-(n - 1), 0))}, chunk
    )
    return (
        rolled.join(means, SCENE)
        .withColumn("apl_nits", F.lit(0.6) * pq_to_nits("_rolling") + F.lit(0.4) * F.col("scene_apl_nits"))
        .drop("_rolling")
    )


def smooth_knee(placed: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """Replace ``knee_nits`` by its mean over the last ``window`` frames of the scene."""
    smoothed = halo_window(
        placed, SCENE, "scene_pos", window - 1,
        {"_knee": lambda w: F.avg("knee_nits").over(w.rowsBetween(-(window - 1), 0))}, chunk,
    )
    return smoothed.drop("knee_nits").withColumnRenamed("_knee", "knee_nits")


def raw_target(df: DataFrame, profile: str = "balanced") -> DataFrame:
    """Add ``raw_target`` from peak_pq, apl_nits, scene_apl_nits and knee_nits."""
    p = profile_named(profile)
    peak = c_pq_to_nits("peak_pq").cast("int")
    knee = F.col("knee_nits")
    level = F.lit(0.7) * F.col("apl_nits") + F.lit(0.3) * F.col("scene_apl_nits")

    def within(bounds: tuple[int, int], factor: float) -> Column:
        return F.least(clamp(peak, *bounds).cast("double"), knee * F.lit(factor))

    target = (
        F.when(peak > p.extreme_peak, F.least(knee, F.lit(float(p.extreme_peak))))
        .when(level < DARK_BELOW, within(p.dark, p.dark_knee))
        .when(level < BRIGHT_FROM, within(p.medium, p.medium_knee))
        .otherwise(within(p.bright, p.bright_knee))
    )
    return df.withColumn("raw_target", clamp(target, 0.0, 65535.0).cast("int"))


def delta_limit(
    df: DataFrame, column: str, name: str, max_delta: int, reset_by: list[str] | None = None,
    pos: str = "frame_idx", chunk: int = CHUNK, bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """Limit the change per frame; across scenes by default, restarting per key with ``reset_by``."""
    keys = reset_by or ["clip_id"]
    limited = limit_steps(df, keys, pos, column, name, max_delta, chunk, bounds)
    return df.join(limited, [*keys, pos])


def smooth_targets(
    placed: DataFrame,
    alpha: float = DEFAULT_ALPHA,
    two_way: bool = True,
    max_delta: int = DEFAULT_MAX_DELTA,
    chunk: int = CHUNK,
    bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """Forward and backward EMA of ``target_nits`` averaged, rounded and limited again per scene.

    ``placed`` has ``scene_pos``. Scenes with a missing target stay as they are; a factor
    outside (0, 1] switches the smoother off.
    """
    if not 0.0 < alpha <= 1.0:
        return placed
    facts = placed.groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("_len"), F.count("target_nits").alias("_known")
    )
    series = (
        placed.select(*SCENE, "scene_pos", F.col("target_nits").cast("double").alias("_t"))
        .join(facts.where(F.col("_len") == F.col("_known")).drop("_known"), SCENE)
    )
    if two_way:
        smooth = ema(series, SCENE, "scene_pos", {"_t": "_f"}, alpha, "first", chunk, {"_t": "_b"}, "_len")
        value = (F.col("_f") + F.col("_b")) / 2.0
    else:
        smooth = ema(series, SCENE, "scene_pos", {"_t": "_f"}, alpha, "first", chunk)
        value = F.col("_f")
    wanted = smooth.select(*SCENE, "scene_pos", clamp(F.round(value), 0.0, 65535.0).cast("int").alias("_want"))
    # The limiter reads its input twice; the narrow table is written once instead of averaged twice.
    limited = limit_steps(staged(wanted, "wanted"), SCENE, "scene_pos", "_want", "_smooth", max_delta, chunk, bounds)
    return (
        placed.join(limited, [*SCENE, "scene_pos"], "left")
        .withColumn("target_nits", F.coalesce("_smooth", "target_nits"))
        .drop("_smooth")
    )


def optimizer_pass(
    framed: DataFrame, scenes: DataFrame, profile: str = "balanced", chunk: int = CHUNK
) -> DataFrame:
    """Rolling level, smoothed knee, heuristic and limiter: fills ``target_nits``."""
    p = profile_named(profile)
    narrow = scene_position(
        framed.select(
            *SCENE, "frame_idx", "avg_pq", "peak_pq", E.highlight_knee_nits(F.col("lum_hist")).alias("knee_nits")
        ),
        scenes,
    )
    ready = smooth_knee(rolling_apl(narrow, scenes, ROLLING_FRAMES, chunk), p.knee_window, chunk)
    raw = staged(raw_target(ready, profile).select(*FRAME, "raw_target"), "raw-targets")
    limited = limit_steps(
        raw, ["clip_id"], "frame_idx", "raw_target", "target_nits", p.max_delta, chunk, target_bounds(profile)
    )
    return framed.drop("target_nits").join(limited, FRAME)
