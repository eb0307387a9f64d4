"""Ordered series: distances, cuts, scenes, smoothing, targets, roll-ups and the whole measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transfer as T
from ..operators import (
    checks, measure, metadata, ordered as O, rollups, samples as S, scenes as SC, smoothing, targets,
)
from ..plans.analyze import Options, analyze
from . import adapters as A
from .pixels import FINE_SQL, LUM_PCT_SQL, LUM_SQL, low_sql, top_sql
from .registry import query
from .scalars import six

FRAME = ["clip_id", "frame_idx"]
KEY = "clip_id, frame_idx"
LUMA, RGB = A.sql_luma(), A.sql_max_rgb()
THRESHOLD = 60.0  # the sparse samples of these tables make every distance large


def measured(spark, sf_dir):
    return measure.measure_frames(A.samples(spark, sf_dir))


# Distances and cuts -----------------------------------------------------------------------
DISTANCE_SQL = f"""
    WITH pct AS ({LUM_PCT_SQL}), terms AS (
      SELECT clip_id, frame_idx, coalesce(a.pct, 0) AS a, coalesce(b.pct, 0) AS b
      FROM pct a FULL JOIN (SELECT clip_id, frame_idx + 1 AS frame_idx, bin, pct FROM pct) b USING (clip_id, frame_idx, bin))
    SELECT f.clip_id, f.frame_idx, CASE WHEN f.frame_idx > 0 THEN d END AS distance FROM (SELECT DISTINCT {KEY} FROM pct) f
    LEFT JOIN (SELECT {KEY}, sum((a - b) * (a - b) / (a + b + 1e-6::DOUBLE)) AS d FROM terms GROUP BY ALL) USING (clip_id, frame_idx)"""


@query("w1_histogram_distance", f"SELECT {KEY}, round(distance, 5) AS distance FROM ({DISTANCE_SQL})")
def w1(spark, sf_dir):
    return SC.histogram_distance(measured(spark, sf_dir)).select(*FRAME, F.round("distance", 5).alias("distance"))


@query("w2_hold_last", f"""
    SELECT {KEY}, last_value(CASE WHEN k % 3 = 0 THEN k END IGNORE NULLS) OVER w AS k, last_value(CASE WHEN k % 5 = 0 THEN event_id END IGNORE NULLS) OVER w AS event_id
    FROM ({A.SERIES_SQL}) WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)""")
def w2(spark, sf_dir):
    holes = A.series(spark, sf_dir).select(
        *FRAME, F.when(F.col("k") % 3 == 0, F.col("k")).alias("k"), F.when(F.col("k") % 5 == 0, F.col("event_id")).alias("event_id")
    )
    return O.hold_last(holes, ["clip_id"], "frame_idx", ["k", "event_id"])


@query("w2_hold_analysed", f"""
    SELECT f.clip_id, f.frame_idx, s.k FROM ({A.SERIES_SQL}) f JOIN ({A.SERIES_SQL}) s
    ON s.clip_id = f.clip_id AND s.frame_idx = f.frame_idx - f.frame_idx % 3""")
def w2_analysed(spark, sf_dir):
    every = A.series(spark, sf_dir).select(*FRAME, "k")
    return SC.hold_analysed(every, S.every_nth_frame(every, 3), 3)


@query("w2_hold_over_gaps", f"""
    SELECT clip_id, frame_idx, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_idx),
           first_value(s IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS k
    FROM (SELECT {KEY}, CASE WHEN frame_idx % 3 = 0 AND frame_idx % 7 NOT IN (0, 5) THEN k END AS s FROM ({A.SERIES_SQL}))""")
def w2_gaps(spark, sf_dir):
    """Some sampled frames are absent: the last row that is there is held."""
    every = A.series(spark, sf_dir).select(*FRAME, "k")
    return SC.hold_analysed(every, S.every_nth_frame(every, 3).where(~(F.col("frame_idx") % 7).isin(0, 5)), 3)


_GAPPY_SQL = f"SELECT {KEY}, scene_id, avg_nits FROM ({A.SERIES_SQL}) WHERE frame_idx NOT IN (255, 256, 257, 511, 512) AND frame_idx % 97 != 3"


def _gappy(spark, sf_dir):
    rows = A.series(spark, sf_dir).select(*FRAME, "scene_id", "avg_nits")
    return rows.where(~F.col("frame_idx").isin(255, 256, 257, 511, 512) & (F.col("frame_idx") % 97 != 3))


@query("w3_smooth_over_gaps", f"SELECT {KEY}, avg(avg_nits) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS 4 PRECEDING) AS smoothed FROM ({_GAPPY_SQL})")
def w3_gaps(spark, sf_dir):
    """A series with holes, some at the borders of chunks: the rows that are there are averaged."""
    return SC.smooth_distance(_gappy(spark, sf_dir).withColumnRenamed("avg_nits", "distance"), 5).select(*FRAME, "smoothed")


@query("w12_knee_over_gaps", f"SELECT {KEY}, round(avg(avg_nits) OVER (PARTITION BY clip_id, scene_id ORDER BY frame_idx ROWS 6 PRECEDING), 6) AS knee_nits FROM ({_GAPPY_SQL})")
def w12_gaps(spark, sf_dir):
    placed = smoothing.scene_position(_gappy(spark, sf_dir)).withColumnRenamed("avg_nits", "knee_nits")
    return targets.smooth_knee(placed, 7).select(*FRAME, F.round("knee_nits", 6).alias("knee_nits"))


_SERIES_DISTANCE = f"SELECT {KEY}, CASE WHEN frame_idx > 0 THEN avg_nits END AS distance FROM ({A.SERIES_SQL})"
SMOOTHED_SQL = f"SELECT {KEY}, avg(distance) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS 4 PRECEDING) AS smoothed FROM ({_SERIES_DISTANCE})"


def _series_distance(spark, sf_dir):
    return A.series(spark, sf_dir).select(*FRAME, F.when(F.col("frame_idx") > 0, F.col("avg_nits")).alias("distance"))


@query("w3_smooth_distance", f"SELECT {KEY}, round(smoothed, 6) AS smoothed FROM ({SMOOTHED_SQL})")
def w3(spark, sf_dir):
    return SC.smooth_distance(_series_distance(spark, sf_dir)).select(*FRAME, F.round("smoothed", 6).alias("smoothed"))


def cuts_sql(smoothed: str, threshold: float, gap: int = 24) -> str:
    return f"""
    WITH RECURSIVE s AS MATERIALIZED ({smoothed}), fold AS (
      SELECT DISTINCT clip_id, 0 AS frame_idx, 0 AS last FROM s
      UNION ALL
      SELECT s.clip_id, s.frame_idx, CASE WHEN s.smoothed > {threshold!r} AND s.frame_idx - f.last >= {gap} THEN s.frame_idx ELSE f.last END
      FROM fold f JOIN s ON s.clip_id = f.clip_id AND s.frame_idx = f.frame_idx + 1)
    SELECT {KEY} FROM fold WHERE frame_idx > 0 AND last = frame_idx"""


@query("w4_accept_cuts", cuts_sql(SMOOTHED_SQL, 55.0))
def w4(spark, sf_dir):
    return SC.accept_cuts(SC.smooth_distance(_series_distance(spark, sf_dir)), 55.0)


def _marks(spark, sf_dir):
    return A.series(spark, sf_dir).where((F.col("k") == 7) & (F.col("frame_idx") > 0)).select(*FRAME)


MARKS_SQL = f"SELECT {KEY} FROM ({A.SERIES_SQL}) WHERE k = 7 AND frame_idx > 0"
COUNTS_SQL = f"SELECT clip_id, count(*) AS frame_count FROM ({A.SERIES_SQL}) GROUP BY ALL"
RANGES_SQL = f"""
    SELECT clip_id, (row_number() OVER w - 1)::INT AS scene_id, frame_idx AS start, (coalesce(lead(frame_idx) OVER w, frame_count) - 1)::INT AS "end"
    FROM (SELECT * FROM ({MARKS_SQL}) UNION ALL SELECT clip_id, 0 FROM ({COUNTS_SQL})) JOIN ({COUNTS_SQL}) USING (clip_id)
    WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)"""


@query("w5_scenes_from_cuts", RANGES_SQL)
def w5(spark, sf_dir):
    return SC.scenes_from_cuts(_marks(spark, sf_dir), checks.frame_counts(A.series(spark, sf_dir)))


@query("w5_repair_scenes", f"""
    SELECT clip_id, scene_id, CASE WHEN s > e THEN 0 ELSE s END AS start, CASE WHEN s > e THEN frame_count - 1 ELSE e END::INT AS "end" FROM (
      SELECT clip_id, scene_id, least(start + scene_id % 3 * 400, frame_count - 1)::INT AS s, least("end" + scene_id % 5 * 100, frame_count - 1)::INT AS e, frame_count
      FROM ({RANGES_SQL}) JOIN ({COUNTS_SQL}) USING (clip_id))""")
def w5_repair(spark, sf_dir):
    counts = checks.frame_counts(A.series(spark, sf_dir))
    bent = SC.scenes_from_cuts(_marks(spark, sf_dir), counts).select(
        "clip_id", "scene_id",
        (F.col("start") + F.col("scene_id") % 3 * 400).alias("start"), (F.col("end") + F.col("scene_id") % 5 * 100).alias("end"),
    )
    return SC.repair_scenes(bent, counts)


@query("o1_sort_cuts", f"SELECT {KEY} FROM ({A.SERIES_SQL})")
def o1(spark, sf_dir):
    """Every frame as a cut; ``tests/test_frames.py`` looks at the order itself."""
    return SC.sort_cuts(A.series(spark, sf_dir).select(*FRAME))


@query("j3_attach_scene", f"""
    SELECT s.clip_id, s.frame_idx, scene_id FROM (SELECT {KEY} FROM ({A.SERIES_SQL})) s JOIN ({RANGES_SQL}) r
    ON r.clip_id = s.clip_id AND s.frame_idx BETWEEN start AND "end" """)
def j3(spark, sf_dir):
    frames = A.series(spark, sf_dir).select(*FRAME)
    scenes = SC.scenes_from_cuts(_marks(spark, sf_dir), checks.frame_counts(frames))
    return SC.attach_scene(frames, scenes)


@query("j3_scene_by_running_count", f"""
    SELECT {KEY}, sum(CASE WHEN k = 7 AND frame_idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_idx)::INT AS scene_id FROM ({A.SERIES_SQL})""")
def j3_running(spark, sf_dir):
    return SC.attach_scenes(A.series(spark, sf_dir).select(*FRAME), _marks(spark, sf_dir))


# Smoothing --------------------------------------------------------------------------------
SCENED = "frame_idx // 30"  # thirty frames make a scene where no cut is detected
EMA_HIST_SQL = f"""
    WITH pct AS (SELECT *, ({SCENED})::INT AS scene_id FROM ({LUM_PCT_SQL})),
    state AS (SELECT f.clip_id, f.frame_idx, p.bin, sum(0.1::DOUBLE * pow(0.9::DOUBLE, f.frame_idx - p.frame_idx) * p.pct) AS v
              FROM (SELECT DISTINCT clip_id, frame_idx, scene_id FROM pct) f JOIN pct p
              ON p.clip_id = f.clip_id AND p.scene_id = f.scene_id AND p.frame_idx <= f.frame_idx GROUP BY ALL)
    SELECT {KEY}, bin, v * 100.0::DOUBLE / sum(v) OVER (PARTITION BY {KEY}) AS pct FROM state"""


def _scened(spark, sf_dir):
    return measured(spark, sf_dir).withColumn("scene_id", F.expr("frame_idx div 30").cast("int"))


def _bins(frames, column="lum_hist"):
    return (
        frames.select(*FRAME, F.posexplode(column).alias("bin", "pct")).where(F.col("pct") > 0)
        .withColumn("pct", F.round("pct", 6))
    )


@query("w6_ema_histogram", f"SELECT {KEY}, bin, round(pct, 6) AS pct FROM ({EMA_HIST_SQL})")
def w6(spark, sf_dir):
    placed = smoothing.scene_position(_scened(spark, sf_dir).select("clip_id", "scene_id", "frame_idx", "lum_hist"))
    return _bins(smoothing.ema_histogram(placed))


DENSE_SQL = f"""
    SELECT clip_id, frame_idx, ({SCENED})::INT AS scene_id, (frame_idx % 30)::INT AS pos, list(coalesce(pct, 0.0) ORDER BY bin) AS h
    FROM (SELECT DISTINCT {KEY} FROM ({LUM_SQL})) CROSS JOIN (SELECT range::INT AS bin FROM range(256)) LEFT JOIN ({LUM_PCT_SQL}) USING (clip_id, frame_idx, bin) GROUP BY ALL"""
MEDIAN_SQL = f"""
    WITH RECURSIVE d AS MATERIALIZED ({DENSE_SQL}), fold AS (
      SELECT clip_id, scene_id, frame_idx, pos, NULL::DOUBLE[] AS older, h AS out FROM d WHERE pos = 0
      UNION ALL
      SELECT clip_id, scene_id, frame_idx, pos, older, list_transform(m, lambda v: v * (100.0::DOUBLE / list_sum(m))) FROM (
        SELECT d.clip_id, d.scene_id, d.frame_idx, d.pos, f.out AS older,
          CASE WHEN f.older IS NULL THEN list_transform(range(1, 257), lambda i: (f.out[i] + d.h[i]) / 2)
               ELSE list_transform(range(1, 257), lambda i: greatest(least(f.out[i], d.h[i]), least(greatest(f.out[i], d.h[i]), f.older[i]))) END AS m
        FROM fold f JOIN d ON d.clip_id = f.clip_id AND d.scene_id = f.scene_id AND d.pos = f.pos + 1))
    SELECT {KEY}, (i - 1)::INT AS bin, out[i] AS pct FROM (SELECT {KEY}, out, unnest(range(1, 257)) AS i FROM fold) WHERE out[i] > 0"""


@query("w7_median_histogram", f"SELECT {KEY}, bin, round(pct, 6) AS pct FROM ({MEDIAN_SQL})")
def w7(spark, sf_dir):
    placed = smoothing.scene_position(_scened(spark, sf_dir).select("clip_id", "scene_id", "frame_idx", "lum_hist"))
    return _bins(smoothing.median_histogram(placed, 3))


def ema_sql(source: str, value: str, weight: float, order: str = "scene_pos") -> str:
    """EMA that starts at the first value, as a weighted sum over the earlier rows of the scene."""
    keep = 1.0 - weight
    return f"""
    SELECT a.clip_id, a.scene_id, a.frame_idx, any_value(a.{order}) AS pos,
           sum(CASE WHEN b.{order} = 0 THEN 1.0::DOUBLE ELSE {weight!r}::DOUBLE END * pow({keep!r}::DOUBLE, a.{order} - b.{order}) * b.{value}) AS s
    FROM ({source}) a JOIN ({source}) b ON a.clip_id = b.clip_id AND a.scene_id = b.scene_id AND b.{order} <= a.{order} GROUP BY ALL"""


def avg_frames_sql(value: str) -> str:
    return f"""SELECT {KEY}, ({SCENED})::INT AS scene_id, (frame_idx % 30)::INT AS scene_pos, avg({value}) AS v FROM ({A.SAMPLES_SQL}) GROUP BY ALL"""


_SERIES_AVG = f"SELECT {KEY}, scene_id, scene_pos, {A.sql_nits_to_pq('avg_nits')} AS v FROM ({A.SERIES_SQL})"


def _series_avg(spark, sf_dir):
    return A.series(spark, sf_dir).select(*FRAME, "scene_id", "scene_pos", T.nits_to_pq("avg_nits").alias("avg_pq"))


@query("w8_smooth_average", f"""
    SELECT {KEY}, round(list_sort(list(s) OVER w)[(count(*) OVER w) // 2 + 1], 6) AS avg_pq FROM ({ema_sql(_SERIES_AVG, 'v', 0.1)})
    WINDOW w AS (PARTITION BY clip_id, scene_id ORDER BY pos ROWS 2 PRECEDING)""")
def w8(spark, sf_dir):
    out = smoothing.smooth_average(_series_avg(spark, sf_dir), ["avg_pq"], 0.1, 3)
    return out.select(*FRAME, six(F.col("avg_pq"), "avg_pq"))


_EMA_TOP = f"""
    SELECT {KEY}, max(CASE WHEN cum >= 1.0 THEN bin END) AS bin FROM (
      SELECT {KEY}, bin, sum(pct) OVER (PARTITION BY {KEY} ORDER BY bin DESC) AS cum FROM ({EMA_HIST_SQL})) GROUP BY ALL"""


@query("w9_smoothing_pass", f"""
    SELECT t.clip_id, t.frame_idx, round(t.bin / 255.0::DOUBLE, 6) AS peak_pq, round(l.s, 6) AS avg_pq, round(r.s, 6) AS avg_max_rgb_pq, round(c.v, 4) AS centre
    FROM ({_EMA_TOP}) t JOIN ({ema_sql(avg_frames_sql(LUMA), 'v', 0.1)}) l USING (clip_id, frame_idx) JOIN ({ema_sql(avg_frames_sql(RGB), 'v', 0.1)}) r USING (clip_id, frame_idx)
    JOIN (SELECT {KEY}, sum(bin * pct) AS v FROM ({EMA_HIST_SQL}) GROUP BY ALL) c USING (clip_id, frame_idx)""")
def w9(spark, sf_dir):
    out = smoothing.smoothing_pass(_scened(spark, sf_dir), peak_source="histogram99")
    centre = F.aggregate(F.transform("lum_hist", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return out.select(*FRAME, *[six(F.col(c), c) for c in ("peak_pq", "avg_pq", "avg_max_rgb_pq")], F.round(centre, 4).alias("centre"))


# Targets ----------------------------------------------------------------------------------
APL_SQL = f"""
    SELECT clip_id, frame_idx, scene_id, scene_pos, scene_apl, 0.6::DOUBLE * {A.sql_pq_to_nits('rolling')} + 0.4::DOUBLE * scene_apl AS apl FROM (
      SELECT *, {A.sql_pq_to_nits('scene_avg')} AS scene_apl FROM (
        SELECT *, avg(v) OVER (PARTITION BY clip_id, scene_id ORDER BY scene_pos ROWS 239 PRECEDING) AS rolling,
               avg(v) OVER (PARTITION BY clip_id, scene_id) AS scene_avg FROM ({_SERIES_AVG})))"""


def _apl(spark, sf_dir):
    placed = _series_avg(spark, sf_dir)
    scenes = placed.groupBy("clip_id", "scene_id").agg(F.avg("avg_pq").alias("avg_pq"))
    return targets.rolling_apl(placed, scenes)


@query("w11_rolling_apl", f"SELECT {KEY}, round(apl, 5) AS apl_nits, round(scene_apl, 5) AS scene_apl_nits FROM ({APL_SQL})")
def w11(spark, sf_dir):
    out = _apl(spark, sf_dir)
    return out.select(*FRAME, F.round("apl_nits", 5).alias("apl_nits"), F.round("scene_apl_nits", 5).alias("scene_apl_nits"))


KNEE_SQL = f"""
    SELECT {KEY}, avg(knee) OVER (PARTITION BY clip_id, scene_id ORDER BY scene_pos ROWS 4 PRECEDING) AS knee FROM (
      SELECT *, avg_nits * (1 + k / 20.0::DOUBLE) AS knee FROM ({A.SERIES_SQL}))"""


def _knees(spark, sf_dir):
    knee = F.col("avg_nits") * (F.lit(1) + F.col("k") / F.lit(20.0))
    rows = A.series(spark, sf_dir).select("clip_id", "scene_id", "frame_idx", "scene_pos", knee.alias("knee_nits"))
    return targets.smooth_knee(rows, 5)


@query("w12_smooth_knee", f"SELECT {KEY}, round(knee, 6) AS knee_nits FROM ({KNEE_SQL})")
def w12(spark, sf_dir):
    return _knees(spark, sf_dir).select(*FRAME, F.round("knee_nits", 6).alias("knee_nits"))


def raw_target_sql(source: str) -> str:
    """The balanced profile over rows with peak (whole nits), apl, scene_apl and knee."""
    return f"""
    SELECT {KEY}, trunc(CASE WHEN peak > 4000 THEN least(knee, 4000.0)
        WHEN 0.7::DOUBLE * apl + 0.3::DOUBLE * scene_apl < 50 THEN least(greatest(least(peak, 2000), 800), knee * 1.2::DOUBLE)
        WHEN 0.7::DOUBLE * apl + 0.3::DOUBLE * scene_apl < 150 THEN least(greatest(least(peak, 1500), 600), knee * 1.1::DOUBLE)
        ELSE least(greatest(least(peak, 1000), 400), knee * 1.0::DOUBLE) END)::INT AS raw_target FROM ({source})"""


_PEAK_PQ = A.sql_nits_to_pq("peak_nits")
RAW_SQL = raw_target_sql(f"""
    SELECT a.clip_id, a.frame_idx, trunc({A.sql_pq_to_nits('p.pq')})::INT AS peak, apl, scene_apl, knee FROM ({APL_SQL}) a
    JOIN ({KNEE_SQL}) USING (clip_id, frame_idx) JOIN (SELECT {KEY}, {A.sql_nits_to_pq('peak_nits + 0.25')} AS pq FROM ({A.SERIES_SQL})) p USING (clip_id, frame_idx)""")


def _raw_targets(spark, sf_dir):
    # A quarter nit keeps whole-nit peaks away from the truncation border.
    peaks = A.series(spark, sf_dir).select(*FRAME, T.c_nits_to_pq(F.col("peak_nits") + 0.25).alias("peak_pq"))
    joined = _apl(spark, sf_dir).join(_knees(spark, sf_dir).select(*FRAME, "knee_nits"), FRAME).join(peaks, FRAME)
    return targets.raw_target(joined)


@query("w13_raw_target", RAW_SQL)
def w13(spark, sf_dir):
    return _raw_targets(spark, sf_dir).select(*FRAME, "raw_target")


def limit_sql(source: str, value: str, keys: str, pos: str, step: int) -> str:
    """Follow ``value`` by at most ``step`` per row, starting at the first value of each key."""
    on = " AND ".join(f"s.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""
    WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM ({source})), fold AS (
      SELECT {keys}, {pos}, {value}::INT AS p FROM s WHERE {pos} = 0
      UNION ALL
      SELECT {named}, s.{pos}, greatest(f.p - {step}, least(f.p + {step}, s.{value}))::INT FROM fold f JOIN s ON {on} AND s.{pos} = f.{pos} + 1)
    SELECT {keys}, {pos}, p FROM fold"""


_STEPS = f"SELECT {KEY}, trunc(peak_nits)::INT AS v FROM ({A.SERIES_SQL})"


@query("w14_delta_limit", f"SELECT clip_id, frame_idx, p AS target_nits FROM ({limit_sql(_STEPS, 'v', 'clip_id', 'frame_idx', 150)})")
def w14(spark, sf_dir):
    steps = A.series(spark, sf_dir).select(*FRAME, F.col("peak_nits").cast("int").alias("v"))
    return targets.delta_limit(steps, "v", "target_nits", 150).select(*FRAME, "target_nits")


_TARGETS = f"SELECT {KEY}, scene_id, scene_pos, (max(scene_pos) OVER (PARTITION BY clip_id, scene_id) - scene_pos)::INT AS back, trunc(avg_nits * 3)::INT AS v FROM ({A.SERIES_SQL})"
TWO_WAY_SQL = f"""
    SELECT clip_id, scene_id, f.pos AS scene_pos, round((f.s + b.s) / 2)::INT AS v
    FROM ({ema_sql(_TARGETS, 'v', 0.2)}) f JOIN ({ema_sql(_TARGETS, 'v', 0.2, 'back')}) b USING (clip_id, scene_id, frame_idx)"""


@query("w15_smooth_targets", f"""
    SELECT clip_id, (scene_id * 700 + scene_pos)::INT AS frame_idx, p AS target_nits FROM ({limit_sql(TWO_WAY_SQL, 'v', 'clip_id, scene_id', 'scene_pos', 20)})""")
def w15(spark, sf_dir):
    placed = A.series(spark, sf_dir).select(
        *FRAME, "scene_id", "scene_pos", (F.col("avg_nits") * 3).cast("int").alias("target_nits")
    )
    return targets.smooth_targets(placed, 0.2, True, 20).select(*FRAME, "target_nits")


# Frame facts shared by the pass on measured frames.
FACTS_SQL = f"""
    SELECT m.clip_id, m.frame_idx, ({SCENED})::INT AS scene_id, (m.frame_idx % 30)::INT AS scene_pos, peak_pq, avg_pq, {A.sql_pq_to_nits('(t.bin / 255.0::DOUBLE)')} AS knee
    FROM (SELECT {KEY}, max({RGB}) AS peak_pq, avg({LUMA}) AS avg_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL) m JOIN ({top_sql(LUM_SQL, 1.0)}) t USING (clip_id, frame_idx)"""


def optimizer_sql(facts: str) -> str:
    """Raw targets of frames with scene_id, scene_pos, peak_pq, avg_pq and knee."""
    return raw_target_sql(f"""
    SELECT {KEY}, trunc({A.sql_pq_to_nits('peak_pq')})::INT AS peak, 0.6::DOUBLE * {A.sql_pq_to_nits('rolling')} + 0.4::DOUBLE * {A.sql_pq_to_nits('scene_avg')} AS apl,
           {A.sql_pq_to_nits('scene_avg')} AS scene_apl, smooth AS knee FROM (
      SELECT *, avg(avg_pq) OVER (PARTITION BY clip_id, scene_id ORDER BY scene_pos ROWS 239 PRECEDING) AS rolling, avg(avg_pq) OVER (PARTITION BY clip_id, scene_id) AS scene_avg,
             avg(knee) OVER (PARTITION BY clip_id, scene_id ORDER BY scene_pos ROWS 4 PRECEDING) AS smooth FROM ({facts}))""")


@query("w18_optimizer_pass", f"""
    SELECT clip_id, frame_idx, p AS target_nits FROM ({limit_sql(optimizer_sql(FACTS_SQL), 'raw_target', 'clip_id', 'frame_idx', 200)})""")
def w18(spark, sf_dir):
    framed = _scened(spark, sf_dir)
    return targets.optimizer_pass(framed, rollups.scene_stats(framed)).select(*FRAME, "target_nits")


# Roll-ups ---------------------------------------------------------------------------------
_SERIES_PQ = f"SELECT *, {_PEAK_PQ} AS peak_pq, {A.sql_nits_to_pq('avg_nits')} AS avg_pq FROM ({A.SERIES_SQL})"


def series_frames(spark, sf_dir):
    """Series as frames with peak, averages, minimum and targets (one frame in nine without)."""
    base = A.series(spark, sf_dir)
    peak, avg = T.c_nits_to_pq("peak_nits"), T.c_nits_to_pq("avg_nits")
    return base.select(
        *FRAME, "scene_id", "scene_pos", peak.alias("peak_pq"), avg.alias("avg_pq"),
        (avg * F.lit(0.1)).alias("min_pq"), F.least(avg * F.lit(1.1), F.lit(1.0)).alias("avg_max_rgb_pq"),
        F.when(F.col("k") % 9 != 0, F.col("k") * 10).alias("target_nits"),
    )


SERIES_FRAMES_SQL = f"""SELECT {KEY}, scene_id, scene_pos, peak_pq, avg_pq, avg_pq * 0.1::DOUBLE AS min_pq, least(avg_pq * 1.1::DOUBLE, 1.0) AS avg_max_rgb_pq,
    CASE WHEN k % 9 != 0 THEN k * 10 END AS target_nits FROM ({_SERIES_PQ})"""
_NITS = f"SELECT clip_id, round({A.sql_pq_to_nits('peak_pq')})::INT AS nits FROM ({SERIES_FRAMES_SQL})"


@query("a13_max_cll", f"""
    SELECT clip_id, max(nits) AS maxcll, max(CASE WHEN i = p99 THEN nits END) AS h99, max(CASE WHEN i = p999 THEN nits END) AS h999 FROM (
      SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY nits) - 1 AS i, least(greatest(ceil(0.99::DOUBLE * count(*) OVER (PARTITION BY clip_id) - 1), 0), count(*) OVER (PARTITION BY clip_id) - 1) AS p99,
             least(greatest(ceil(0.999::DOUBLE * count(*) OVER (PARTITION BY clip_id) - 1), 0), count(*) OVER (PARTITION BY clip_id) - 1) AS p999 FROM ({_NITS})) GROUP BY ALL""")
def a13(spark, sf_dir):
    frames = series_frames(spark, sf_dir)
    plain, h99, h999 = (rollups.max_cll(frames, s) for s in ("max", "histogram99", "histogram999"))
    return plain.join(h99.withColumnRenamed("maxcll", "h99"), "clip_id").join(h999.withColumnRenamed("maxcll", "h999"), "clip_id")


FALL_SQL = f"""SELECT clip_id, round(max(n))::INT AS maxfall, round(avg(n))::INT AS avgfall FROM (SELECT clip_id, {A.sql_pq_to_nits('avg_pq')} AS n FROM ({SERIES_FRAMES_SQL})) GROUP BY ALL"""


@query("a14_fall", FALL_SQL)
def a14(spark, sf_dir):
    return rollups.fall(series_frames(spark, sf_dir))


HEADER_SQL = f"""
    SELECT clip_id, 6 AS version, count(DISTINCT scene_id)::INT AS scene_count, count(*)::INT AS frame_count, 3 AS flags, max(round({A.sql_pq_to_nits('peak_pq')}))::INT AS maxcll,
           any_value(maxfall) AS maxfall, any_value(avgfall) AS avgfall, max(round({A.sql_pq_to_nits('peak_pq')}))::INT AS target_peak_nits
    FROM ({SERIES_FRAMES_SQL}) JOIN ({FALL_SQL}) USING (clip_id) GROUP BY clip_id"""


def series_headers(spark, sf_dir, version=6):
    frames = series_frames(spark, sf_dir)
    return rollups.headers(frames, rollups.scene_stats(frames), version)


@query("a15_headers", HEADER_SQL)
def a15(spark, sf_dir):
    return series_headers(spark, sf_dir)


SCENE_STATS_SQL = f"""
    SELECT clip_id, scene_id, min(frame_idx) AS start, max(frame_idx) AS "end", trunc({A.sql_pq_to_nits('max(peak_pq)')})::INT AS peak_nits, avg(avg_pq) AS avg_pq
    FROM (SELECT * REPLACE ({A.sql_nits_to_pq('peak_nits + 0.25')} AS peak_pq) FROM ({_SERIES_PQ})) GROUP BY clip_id, scene_id"""


@query("a16_scene_stats", f"SELECT * REPLACE (round(avg_pq, 6) AS avg_pq) FROM ({SCENE_STATS_SQL})")
def a16(spark, sf_dir):
    peaks = A.series(spark, sf_dir).select(*FRAME, T.c_nits_to_pq(F.col("peak_nits") + 0.25).alias("peak_pq"))
    framed = series_frames(spark, sf_dir).drop("peak_pq").join(peaks, FRAME)
    return rollups.scene_stats(framed).withColumn("avg_pq", F.round("avg_pq", 6))


SCENE_L1_SQL = f"""
    SELECT clip_id, scene_id, min(frame_idx) AS start, max(frame_idx) AS "end", {A.sql_pq12('min(min_pq)')} AS min_pq_12bit, {A.sql_pq12('avg(avg_pq)')} AS avg_luma_pq_12bit,
           {A.sql_pq12('avg(avg_max_rgb_pq)')} AS avg_max_rgb_pq_12bit, {A.sql_pq12('max(peak_pq)')} AS max_pq_12bit FROM ({SERIES_FRAMES_SQL}) GROUP BY clip_id, scene_id"""


@query("a17_scene_l1", SCENE_L1_SQL)
def a17(spark, sf_dir):
    return rollups.scene_l1(series_frames(spark, sf_dir))


@query("a21_frame_summary", f"""
    SELECT clip_id, count(*) AS frames, round(max(peak_pq), 6) AS max_peak_pq, round(avg(peak_pq), 6) AS avg_peak_pq, round(max(avg_pq), 6) AS max_avg_pq, round(avg(avg_pq), 6) AS avg_avg_pq,
           count(target_nits) AS with_target, round(avg(target_nits), 6) AS avg_target_nits, round({A.sql_pq_to_nits('max(peak_pq)')}, 4) AS max_peak_nits, round({A.sql_pq_to_nits('avg(peak_pq)')}, 4) AS avg_peak_nits,
           round({A.sql_pq_to_nits('max(avg_pq)')}, 4) AS max_avg_nits, round({A.sql_pq_to_nits('avg(avg_pq)')}, 4) AS avg_avg_nits FROM ({SERIES_FRAMES_SQL}) GROUP BY clip_id""")
def a21(spark, sf_dir):
    out = rollups.frame_summary(series_frames(spark, sf_dir))
    pq = [six(F.col(c), c) for c in ("max_peak_pq", "avg_peak_pq", "max_avg_pq", "avg_avg_pq", "avg_target_nits")]
    nits = [F.round(c, 4).alias(c) for c in ("max_peak_nits", "avg_peak_nits", "max_avg_nits", "avg_avg_nits")]
    return out.select("clip_id", "frames", "with_target", *pq, *nits)


# Runs of metadata rows --------------------------------------------------------------------
RPU_SQL = f"""
    SELECT clip_id, frame_idx, (frame_idx // 11 % 3)::INT AS min_pq, (800 + frame_idx // 7 * 37 % 900)::INT AS avg_pq,
           (800 + frame_idx // 7 * 37 % 900 + frame_idx // 5 * 53 % 1500 * (event_id % 8 % 3))::INT AS max_pq FROM ({A.SERIES_SQL})"""


def rpu_rows(spark, sf_dir):
    return A.series(spark, sf_dir).select(
        *FRAME,
        F.expr("frame_idx div 11 % 3").cast("int").alias("min_pq"),
        F.expr("800 + frame_idx div 7 * 37 % 900").cast("int").alias("avg_pq"),
        F.expr("800 + frame_idx div 7 * 37 % 900 + frame_idx div 5 * 53 % 1500 * (event_id % 8 % 3)").cast("int").alias("max_pq"),
    )


RUNS_SQL = f"""
    SELECT * EXCLUDE (p) FROM (SELECT *, lag((min_pq, avg_pq, max_pq)) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS p FROM ({RPU_SQL}))
    WHERE p IS NULL OR p IS DISTINCT FROM (min_pq, avg_pq, max_pq)"""


@query("w16_collapse_runs", RUNS_SQL)
def w16(spark, sf_dir):
    return metadata.collapse_runs(rpu_rows(spark, sf_dir), ["min_pq", "avg_pq", "max_pq"])


_MASTERING_SQL = "SELECT 'u' || no AS clip_id, CASE WHEN no > 0 THEN (1600 + 100 * no)::INT END AS mastering_peak_pq FROM (SELECT DISTINCT event_id % 8 AS no FROM events)"


def mastering(spark, sf_dir):
    no = A.table(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("no")).distinct()
    return no.select(
        F.concat(F.lit("u"), F.col("no")).alias("clip_id"), F.when(F.col("no") > 0, F.lit(1600) + 100 * F.col("no")).cast("int").alias("mastering_peak_pq")
    )


HEALTH_SQL = f"""
    SELECT clip_id, mastering_peak_pq, f.n AS frame_count, s.n AS scene_count, f.c AS clipped_frame_count, s.c AS clipped_scene_count, f.d AS degenerate_frame_count, s.d AS degenerate_scene_count,
           round(s.v, 4) AS max_pq_variance, round(f.c / f.n::DOUBLE, 6) AS clipped_frame_ratio, round(s.d / s.n::DOUBLE, 6) AS degenerate_scene_ratio,
           concat_ws(', ', CASE WHEN mastering_peak_pq IS NOT NULL AND f.c / f.n::DOUBLE >= 0.01 THEN printf('clipped-at-ceiling %.1f%% of frames', f.c * 100.0::DOUBLE / f.n) END,
             CASE WHEN s.n >= 3 AND s.v <= 1.0 THEN 'static L1 max' END, CASE WHEN s.d / s.n::DOUBLE >= 0.9 THEN printf('avg≈max in %.1f%% of scenes', s.d * 100.0::DOUBLE / s.n) END) AS reasons
    FROM ({_MASTERING_SQL}) JOIN (SELECT clip_id, count(*) AS n, count(CASE WHEN abs(max_pq - mastering_peak_pq) <= 6 THEN 1 END) AS c, count(CASE WHEN abs(avg_pq - max_pq) <= 4 THEN 1 END) AS d, var_pop(max_pq) AS v
      FROM ({RPU_SQL}) JOIN ({_MASTERING_SQL}) USING (clip_id) GROUP BY clip_id) f USING (clip_id)
    JOIN (SELECT clip_id, count(*) AS n, count(CASE WHEN abs(max_pq - mastering_peak_pq) <= 6 THEN 1 END) AS c, count(CASE WHEN abs(avg_pq - max_pq) <= 4 THEN 1 END) AS d, var_pop(max_pq) AS v
      FROM ({RUNS_SQL}) JOIN ({_MASTERING_SQL}) USING (clip_id) GROUP BY clip_id) s USING (clip_id)"""


def health(spark, sf_dir):
    return metadata.health_report(rpu_rows(spark, sf_dir), mastering(spark, sf_dir))


@query("a22_health_report", HEALTH_SQL)
def a22(spark, sf_dir):
    counts = ("frame_count", "scene_count", "clipped_frame_count", "clipped_scene_count", "degenerate_frame_count", "degenerate_scene_count")
    return health(spark, sf_dir).select(
        "clip_id", "mastering_peak_pq", *counts, F.round("max_pq_variance", 4).alias("max_pq_variance"),
        six(F.col("clipped_frame_ratio"), "clipped_frame_ratio"), six(F.col("degenerate_scene_ratio"), "degenerate_scene_ratio"),
        F.array_join("reasons", ", ").alias("reasons"),
    )


# The whole measurement --------------------------------------------------------------------
MEASURE_CUTS_SQL = cuts_sql(
    f"SELECT {KEY}, avg(distance) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS 4 PRECEDING) AS smoothed FROM ({DISTANCE_SQL})", THRESHOLD
)
FRAMED_SQL = f"""
    SELECT f.clip_id, f.frame_idx, scene_id, (f.frame_idx - min(f.frame_idx) OVER (PARTITION BY f.clip_id, scene_id))::INT AS scene_pos FROM (
      SELECT d.clip_id, d.frame_idx, sum(CASE WHEN c.frame_idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY d.clip_id ORDER BY d.frame_idx)::INT AS scene_id
      FROM (SELECT DISTINCT {KEY} FROM ({A.SAMPLES_SQL})) d LEFT JOIN ({MEASURE_CUTS_SQL}) c ON c.clip_id = d.clip_id AND c.frame_idx = d.frame_idx) f"""
_AVERAGES = f"SELECT * FROM framed JOIN (SELECT {KEY}, avg({LUMA}) AS v, max({RGB}) AS peak_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL) USING (clip_id, frame_idx)"
ANALYSIS_CTES = f"""
    framed AS MATERIALIZED ({FRAMED_SQL}),
    averages AS MATERIALIZED ({_AVERAGES}),
    pcts AS MATERIALIZED (SELECT p.*, scene_id FROM ({LUM_PCT_SQL}) p JOIN framed USING (clip_id, frame_idx)),
    state AS (SELECT f.clip_id, f.frame_idx, p.bin, sum(0.1::DOUBLE * pow(0.9::DOUBLE, f.frame_idx - p.frame_idx) * p.pct) AS v FROM framed f JOIN pcts p
              ON p.clip_id = f.clip_id AND p.scene_id = f.scene_id AND p.frame_idx <= f.frame_idx GROUP BY ALL),
    tops AS (SELECT {KEY}, max(CASE WHEN cum >= 1.0 THEN bin END) AS bin FROM (SELECT {KEY}, bin, sum(v * 100.0::DOUBLE / total) OVER (PARTITION BY {KEY} ORDER BY bin DESC) AS cum
              FROM (SELECT *, sum(v) OVER (PARTITION BY {KEY}) AS total FROM state)) GROUP BY ALL),
    smooth AS MATERIALIZED (SELECT e.clip_id, e.frame_idx, e.scene_id, e.pos AS scene_pos, e.s AS avg_pq, a.peak_pq, {A.sql_pq_to_nits('(t.bin / 255.0::DOUBLE)')} AS knee
              FROM ({ema_sql('SELECT * FROM averages', 'v', 0.1)}) e JOIN averages a USING (clip_id, frame_idx) JOIN tops t USING (clip_id, frame_idx))"""


def _analysis(spark, sf_dir):
    return analyze(A.samples(spark, sf_dir), None, Options(scene_threshold=THRESHOLD))


@query("flagship_headers", f"""
    WITH {ANALYSIS_CTES}
    SELECT clip_id, 5 AS version, count(DISTINCT scene_id)::INT AS scene_count, count(*)::INT AS frame_count, 3 AS flags, max(round({A.sql_pq_to_nits('peak_pq')}))::INT AS maxcll,
           round(max({A.sql_pq_to_nits('avg_pq')}))::INT AS maxfall, round(avg({A.sql_pq_to_nits('avg_pq')}))::INT AS avgfall, NULL::INT AS target_peak_nits FROM smooth GROUP BY clip_id""")
def flagship_headers(spark, sf_dir):
    return _analysis(spark, sf_dir).headers


@query("flagship_headers_planes", """
    SELECT clip_id, count(*)::INT AS frame_count, max(n)::BIGINT AS samples FROM (SELECT clip_id, frame_idx, count(*) AS n FROM (""" + A.MOSAIC_SQL + """) GROUP BY ALL) GROUP BY clip_id""")
def flagship_headers_planes(spark, sf_dir):
    """The whole analysis of stored planes gives the headers that the long samples give."""
    from .pixels import mosaic_planes

    o = Options(scene_threshold=THRESHOLD)
    columns = ("clip_id", "scene_count", "frame_count", "maxcll", "maxfall", "avgfall")
    stored, long = (analyze(given, None, o).headers.select(*columns) for given in (mosaic_planes(spark, sf_dir), A.mosaic(spark, sf_dir)))
    sizes = A.mosaic(spark, sf_dir).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n")).groupBy("clip_id").agg(F.max("n").alias("samples"))
    return stored.join(long, list(columns)).join(sizes, "clip_id").select("clip_id", "frame_count", "samples")


@query("flagship_targets", f"""
    WITH {ANALYSIS_CTES},
    limited AS MATERIALIZED (SELECT clip_id, frame_idx, p AS v FROM ({limit_sql(optimizer_sql('SELECT * FROM smooth'), 'raw_target', 'clip_id', 'frame_idx', 200)})),
    placed AS MATERIALIZED (SELECT l.clip_id, l.frame_idx, scene_id, scene_pos, (max(scene_pos) OVER (PARTITION BY l.clip_id, scene_id) - scene_pos)::INT AS back, v FROM limited l JOIN framed USING (clip_id, frame_idx)),
    two_way AS MATERIALIZED (SELECT clip_id, scene_id, f.pos AS scene_pos, frame_idx, round((f.s + b.s) / 2)::INT AS v
              FROM ({ema_sql('SELECT * FROM placed', 'v', 0.2)}) f JOIN ({ema_sql('SELECT * FROM placed', 'v', 0.2, 'back')}) b USING (clip_id, scene_id, frame_idx))
    SELECT t.clip_id, t.frame_idx, t.scene_id, l.p AS target_nits, round(avg_pq, 6) AS avg_pq, round(peak_pq, 6) AS peak_pq FROM two_way t
    JOIN ({limit_sql('SELECT * FROM two_way', 'v', 'clip_id, scene_id', 'scene_pos', 200)}) l USING (clip_id, scene_id, scene_pos) JOIN smooth s USING (clip_id, frame_idx)""")
def flagship_targets(spark, sf_dir):
    frames = _analysis(spark, sf_dir).frames
    return frames.select(*FRAME, "scene_id", "target_nits", six(F.col("avg_pq"), "avg_pq"), six(F.col("peak_pq"), "peak_pq"))


@query("flagship_scenes", f"""
    WITH {ANALYSIS_CTES}
    SELECT clip_id, scene_id, min(frame_idx) AS start, max(frame_idx) AS "end", round(avg(avg_pq), 6) AS avg_pq FROM smooth GROUP BY clip_id, scene_id""")
def flagship_scenes(spark, sf_dir):
    return _analysis(spark, sf_dir).scenes.select("clip_id", "scene_id", "start", "end", six(F.col("avg_pq"), "avg_pq"))


# Sampling every third frame, skipped frames take over the last measured one.
@query("analysis_with_sampling", f"""
    SELECT f.clip_id, f.frame_idx, round(m.min_pq, 6) AS min_pq FROM (SELECT DISTINCT {KEY} FROM ({A.SAMPLES_SQL})) f
    JOIN (SELECT {KEY}, coalesce(bin, top) / 4095.0::DOUBLE AS min_pq FROM ({low_sql(FINE_SQL, 0.1)})) m ON m.clip_id = f.clip_id AND m.frame_idx = f.frame_idx - f.frame_idx % 3""")
def analysis_with_sampling(spark, sf_dir):
    options = Options(scene_threshold=THRESHOLD, sample_rate=3, optimizer=False)
    return analyze(A.samples(spark, sf_dir), None, options).frames.select(*FRAME, six(F.col("min_pq"), "min_pq"))
