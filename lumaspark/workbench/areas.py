"""Active picture area: usable frames, probes, detection, voting, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import crop as C, samples as S
from . import adapters as A
from .registry import query

FRAME = ["clip_id", "frame_idx"]
KEY = "clip_id, frame_idx"
LIT = f"({A.sql_luma()} > 0.01)"


def flat(df, column="rect"):
    """Rectangle columns in place of the struct."""
    parts = {"x": "x", "y": "y", "w": "width", "h": "height"}
    return df.select(
        *[c for c in df.columns if c != column], *[F.col(f"{column}.{field}").alias(name) for name, field in parts.items()]
    )


SHARE_SQL = f"""
    SELECT {KEY}, avg(CASE WHEN {LIT} THEN 1.0::DOUBLE ELSE 0 END) AS share FROM ({A.MOSAIC_LUMA_SQL})
    WHERE x % 10 = 0 AND y % 10 = 0 GROUP BY ALL"""


@query("p4_usable_frames", f"SELECT {KEY} FROM ({SHARE_SQL}) WHERE share >= 0.05")
def p4(spark, sf_dir):
    return S.usable_frames(A.mosaic_luma(spark, sf_dir))


# Streams of many lengths: one clip per event.
STREAMS_SQL = """SELECT 'v' || event_id AS clip_id, event_id * 17 AS start_tick, (event_id - 5) * 977 AS duration,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 10 END AS duration_s FROM events"""


def streams(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.col("event_id")).alias("clip_id"),
        (F.col("event_id") * 17).alias("start_tick"),
        ((F.col("event_id") - 5) * 977).alias("duration"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") * 10).alias("duration_s"),
    )


@query("p5_probe_ticks", f"""
    SELECT clip_id, probe::INT AS probe, (start_tick + duration * (15 * 6 + 70 * probe) // 600)::BIGINT AS tick
    FROM ({STREAMS_SQL}), (SELECT range AS probe FROM range(7)) WHERE duration > 0""")
def p5(spark, sf_dir):
    return S.probe_ticks(streams(spark, sf_dir), 7)


@query("p5_single_probe", f"SELECT clip_id, 0 AS probe, start_tick + duration // 2 AS tick FROM ({STREAMS_SQL}) WHERE duration > 0")
def p5_single(spark, sf_dir):
    return S.probe_ticks(streams(spark, sf_dir), 1)


@query("p6_sample_windows", f"""
    SELECT clip_id, (i - 1)::INT AS "window", o[i]::INT AS offset_s FROM (
      SELECT clip_id, o, unnest(range(1, len(o) + 1)) AS i FROM (
        SELECT clip_id, CASE WHEN duration_s IS NULL THEN [60, 600, 1800]
          WHEN duration_s >= 240 THEN [trunc(duration_s * 0.15::DOUBLE)::INT, trunc(duration_s * 0.45::DOUBLE)::INT, trunc(duration_s * 0.75::DOUBLE)::INT] ELSE [0] END AS o
        FROM ({STREAMS_SQL})))""")
def p6(spark, sf_dir):
    return S.sample_windows(streams(spark, sf_dir))


TIMED_SQL = f"SELECT clip_id, frame_idx, frame_idx / 2.0::DOUBLE AS time_s FROM ({A.SERIES_SQL})"
TIMED_CLIPS_SQL = f"SELECT clip_id, max(time_s) AS duration_s FROM ({TIMED_SQL}) GROUP BY ALL"


def _windowed(spark, sf_dir):
    timed = A.series(spark, sf_dir).select(*FRAME, (F.col("frame_idx") / 2.0).alias("time_s"))
    clips = timed.groupBy("clip_id").agg(F.max("time_s").alias("duration_s"))
    return timed, S.sample_windows(clips)


@query("p6_frames_in_windows", f"""
    SELECT t.clip_id, frame_idx, w::INT AS "window" FROM ({TIMED_SQL}) t JOIN (
      SELECT clip_id, w, CASE WHEN duration_s >= 240 THEN trunc(duration_s * share)::INT ELSE 0 END AS o FROM ({TIMED_CLIPS_SQL}),
        (VALUES (0, 0.15::DOUBLE), (1, 0.45::DOUBLE), (2, 0.75::DOUBLE)) v(w, share) WHERE duration_s >= 240 OR w = 0) c
    ON t.clip_id = c.clip_id AND time_s >= o AND time_s < o + 20""")
def p6_frames(spark, sf_dir):
    timed, windows = _windowed(spark, sf_dir)
    return S.frames_in_windows(timed, windows).select(*FRAME, "window")


@query("o5_append_windows", f"""
    SELECT clip_id, frame_idx, 0 AS "window" FROM ({TIMED_SQL}) WHERE time_s >= 10 AND time_s < 30
    UNION ALL SELECT clip_id, frame_idx, 1 FROM ({TIMED_SQL}) WHERE time_s >= 20 AND time_s < 40""")
def o5(spark, sf_dir):
    timed = A.series(spark, sf_dir).select(*FRAME, (F.col("frame_idx") / 2.0).alias("time_s"))
    parts = []
    for number, start in enumerate((10, 20)):
        window = timed.select("clip_id").distinct().select("clip_id", F.lit(number).alias("window"), F.lit(start).alias("offset_s"))
        parts.append(S.frames_in_windows(timed, window).select(*FRAME, "window"))
    return S.append_windows(*parts)


RECTS_SQL = """SELECT event_id, 'v' || (event_id // 4) AS clip_id, (event_id % 5 * 3)::INT AS x, (k % 4)::INT AS y,
    (100 + k % 3)::INT AS w, (60 + event_id % 2 * 9)::INT AS h FROM (SELECT *, (props->>'k')::INT AS k FROM events)"""


def rects(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return A.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("v"), F.expr("event_id div 4")).alias("clip_id"),
        G.rect(F.col("event_id") % 5 * 3, k % 4, F.lit(100) + k % 3, F.lit(60) + F.col("event_id") % 2 * 9).alias("rect"),
    )


@query("p7_scale_rect", f"""
    SELECT event_id, x * 4 AS x, y * 4 AS y, w * 4 AS w, h * 4 AS h, (x // 4)::INT AS sx, (y // 4)::INT AS sy,
           greatest(w // 4, 2)::INT AS sw, greatest(h // 64, 2)::INT AS sh FROM ({RECTS_SQL})""")
def p7(spark, sf_dir):
    given = rects(spark, sf_dir)
    scaled, small, tiny = G.scale_rect(F.col("rect"), 4), G.shrink_rect(F.col("rect"), 4), G.shrink_rect(F.col("rect"), 64)
    return flat(given.select("event_id", scaled.alias("rect"), small.alias("s"), tiny["height"].alias("sh"))).select(
        "event_id", "x", "y", "w", "h", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("s.width").alias("sw"), "sh"
    )


# C1: rows and columns with enough lit samples.
CROP_SQL = f"""
    SELECT clip_id, frame_idx, CASE WHEN deg THEN 0 ELSE x END AS x, CASE WHEN deg THEN 0 ELSE y END AS y,
           CASE WHEN deg THEN 40 ELSE w END AS w, CASE WHEN deg THEN 40 ELSE h END AS h FROM (
      SELECT {KEY}, r <= l OR b <= t AS deg, (l - l % 2)::INT AS x, (t - t % 2)::INT AS y,
             greatest((r - (l - l % 2) + 1) - (r - (l - l % 2) + 1) % 2, 2)::INT AS w, greatest((b - (t - t % 2) + 1) - (b - (t - t % 2) + 1) % 2, 2)::INT AS h
      FROM (SELECT {KEY}, coalesce(t, 0) AS t, coalesce(b, 39) AS b, coalesce(l, 0) AS l, coalesce(r, 39) AS r
            FROM (SELECT DISTINCT {KEY} FROM ({A.MOSAIC_LUMA_SQL}))
            LEFT JOIN (SELECT {KEY}, min(y) AS t, max(y) AS b FROM (SELECT {KEY}, y, count(*) AS n FROM ({A.MOSAIC_LUMA_SQL}) WHERE x % 10 = 0 AND {LIT} GROUP BY ALL) WHERE n >= 1 GROUP BY ALL) USING (clip_id, frame_idx)
            LEFT JOIN (SELECT {KEY}, min(x) AS l, max(x) AS r FROM (SELECT {KEY}, x, count(*) AS n FROM ({A.MOSAIC_LUMA_SQL}) WHERE y % 10 = 0 AND {LIT} GROUP BY ALL) WHERE n >= 1 GROUP BY ALL) USING (clip_id, frame_idx)))"""


@query("c1_detect_crop", CROP_SQL)
def c1(spark, sf_dir):
    return flat(C.detect_crop(A.mosaic_luma(spark, sf_dir), A.mosaic_clips(spark, sf_dir)))


@query("c2_rect_matches", f"""
    SELECT a.event_id, abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.x + a.w - b.x - b.w) <= 2 AND abs(a.y + a.h - b.y - b.h) <= 2 AS same
    FROM ({RECTS_SQL}) a JOIN ({RECTS_SQL}) b ON b.event_id = a.event_id + 5""")
def c2(spark, sf_dir):
    a = rects(spark, sf_dir)
    b = a.select((F.col("event_id") - 5).alias("event_id"), F.col("rect").alias("other"))
    return a.join(b, "event_id").select("event_id", G.rect_matches(F.col("rect"), F.col("other")).alias("same"))


@query("c2_rect_union", f"""
    SELECT clip_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({RECTS_SQL}) GROUP BY ALL""")
def c2_union(spark, sf_dir):
    return flat(rects(spark, sf_dir).groupBy("clip_id").agg(G.rect_union(F.col("rect")).alias("rect")))


# Connected components by the closure of "edges within 2"; a clip has four candidates here.
VOTE_SQL = f"""
    WITH RECURSIVE c AS ({RECTS_SQL}), reach AS (
      SELECT clip_id, event_id AS a, event_id AS b FROM c
      UNION
      SELECT r.clip_id, r.a, n.event_id FROM reach r JOIN c m ON m.event_id = r.b JOIN c n ON n.clip_id = r.clip_id
        AND abs(m.x - n.x) <= 2 AND abs(m.y - n.y) <= 2 AND abs(m.x + m.w - n.x - n.w) <= 2 AND abs(m.y + m.h - n.y - n.h) <= 2),
    labels AS (SELECT clip_id, a AS event_id, min(b) AS label FROM reach GROUP BY ALL),
    clusters AS (SELECT clip_id, label, count(*) AS size, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b FROM c JOIN labels USING (clip_id, event_id) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY size DESC, (r - x) * (b - y) DESC, label) AS rn FROM clusters)
    SELECT clip_id, min(x) AS x, min(y) AS y, max(r) - min(x) AS w, max(b) - min(y) AS h, sum(size)::INT AS candidate_count,
           max(CASE WHEN rn = 1 THEN size END)::INT AS modal_count, count(*)::INT AS cluster_count, count(*) > 1 AS variable_ar FROM ranked GROUP BY ALL"""


@query("c3_vote_crop", VOTE_SQL)
def c3(spark, sf_dir):
    return flat(C.vote_crop(rects(spark, sf_dir).withColumnRenamed("event_id", "ord")))


USABLE_SQL = f"SELECT {KEY}, frame_idx * 1000 AS pts, share >= 0.05 AS usable FROM ({SHARE_SQL})"
TICKS_SQL = f"""SELECT clip_id, probe::INT AS probe, (start_tick + duration * (15 * 6 + 70 * probe) // 600)::BIGINT AS tick
    FROM ({A.MOSAIC_CLIPS_SQL}), (SELECT range AS probe FROM range(7))"""
HITS_SQL = f"""
    SELECT clip_id, probe, frame_idx FROM (
      SELECT t.clip_id, probe, frame_idx, usable, row_number() OVER (PARTITION BY t.clip_id, probe ORDER BY frame_idx) AS nth
      FROM ({TICKS_SQL}) t JOIN ({USABLE_SQL}) u ON t.clip_id = u.clip_id AND pts >= tick)
    WHERE usable AND nth <= 120 QUALIFY row_number() OVER (PARTITION BY clip_id, probe ORDER BY nth) = 1"""


def _timed(spark, sf_dir):
    return S.usable_share(A.mosaic_luma(spark, sf_dir)).select(
        *FRAME, (F.col("frame_idx") * 1000).alias("pts"), (F.col("share") >= 0.05).alias("usable")
    )


@query("j10_first_usable_after", HITS_SQL)
def j10(spark, sf_dir):
    return S.first_usable_after(S.probe_ticks(A.mosaic_clips(spark, sf_dir), 7), _timed(spark, sf_dir))


# Detected rectangles of one clip differ by at most the tolerance per frame here, so components equal
# the closure over candidates, written once more for the probed frames.
@query("c4_probed_crop", f"""
    WITH RECURSIVE c AS (SELECT h.clip_id, probe, x, y, w, h FROM ({HITS_SQL}) h JOIN ({CROP_SQL}) r USING (clip_id, frame_idx)), reach AS (
      SELECT clip_id, probe AS a, probe AS b FROM c UNION
      SELECT r.clip_id, r.a, n.probe FROM reach r JOIN c m ON m.clip_id = r.clip_id AND m.probe = r.b JOIN c n ON n.clip_id = r.clip_id
        AND abs(m.x - n.x) <= 2 AND abs(m.y - n.y) <= 2 AND abs(m.x + m.w - n.x - n.w) <= 2 AND abs(m.y + m.h - n.y - n.h) <= 2),
    labels AS (SELECT clip_id, a AS probe, min(b) AS label FROM reach GROUP BY ALL),
    sizes AS (SELECT clip_id, label, count(*) AS size FROM labels GROUP BY ALL)
    SELECT clip_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*)::INT AS candidate_count,
           any_value(modal)::INT AS modal_count, any_value(clusters)::INT AS cluster_count, any_value(clusters) > 1 AS variable_ar
    FROM c JOIN (SELECT clip_id, max(size) AS modal, count(*) AS clusters FROM sizes GROUP BY ALL) USING (clip_id) GROUP BY clip_id""")
def c4(spark, sf_dir):
    frames = _timed(spark, sf_dir).select(*FRAME, "pts")
    return flat(C.probed_crop(A.mosaic_luma(spark, sf_dir), A.mosaic_clips(spark, sf_dir), frames, 7))


@query("c5_fallback_crop", f"""
    SELECT f.clip_id, f.frame_idx, CASE WHEN first IS NULL OR f.frame_idx < first THEN 0 ELSE c.x END AS x,
           CASE WHEN first IS NULL OR f.frame_idx < first THEN 0 ELSE c.y END AS y,
           CASE WHEN first IS NULL OR f.frame_idx < first THEN 40 ELSE c.w END AS w, CASE WHEN first IS NULL OR f.frame_idx < first THEN 40 ELSE c.h END AS h
    FROM (SELECT DISTINCT {KEY} FROM ({A.MOSAIC_LUMA_SQL})) f
    LEFT JOIN (SELECT clip_id, min(frame_idx) AS first FROM ({USABLE_SQL}) WHERE usable GROUP BY ALL) u ON f.clip_id = u.clip_id
    LEFT JOIN ({CROP_SQL}) c ON c.clip_id = f.clip_id AND c.frame_idx = first""")
def c5(spark, sf_dir):
    given = A.mosaic_luma(spark, sf_dir)
    fallback = C.fallback_crop(given, A.mosaic_clips(spark, sf_dir))
    return flat(C.rect_for_frame(given.select(*FRAME).distinct(), fallback))


@query("a24_crop_stability", f"""
    SELECT clip_id, count(found) AS checked, count(CASE WHEN same THEN 1 END) AS matching, count(CASE WHEN full_frame AND NOT same THEN 1 END) AS full_frame,
           count(CASE WHEN found IS NULL THEN 1 END) AS skipped, count(CASE WHEN NOT same AND NOT full_frame THEN 1 END) AS other,
           round(CASE WHEN count(found) > 0 THEN count(CASE WHEN same THEN 1 END) * 100.0::DOUBLE / count(found) END, 6) AS stability_pct
    FROM (SELECT m.clip_id, u.usable AS found,
                 abs(x - rx) <= 2 AND abs(y - ry) <= 2 AND abs(x + w - rx - rw) <= 2 AND abs(y + h - ry - rh) <= 2 AS same,
                 x <= 2 AND y <= 2 AND abs(x + w - 40) <= 2 AND abs(y + h - 40) <= 2 AS full_frame
          FROM (SELECT DISTINCT {KEY} FROM ({A.MOSAIC_LUMA_SQL})) m
          JOIN ({A.MOSAIC_CROPS_SQL}) k ON m.clip_id = k.clip_id
          LEFT JOIN (SELECT * FROM ({USABLE_SQL}) WHERE usable) u ON m.clip_id = u.clip_id AND m.frame_idx = u.frame_idx
          LEFT JOIN ({CROP_SQL}) c ON u.clip_id = c.clip_id AND u.frame_idx = c.frame_idx) GROUP BY ALL""")
def a24(spark, sf_dir):
    given, clips = A.mosaic_luma(spark, sf_dir), A.mosaic_clips(spark, sf_dir)
    usable = S.usable_frames(given)
    candidates = C.detect_crop(given.join(usable, FRAME, "left_semi"), clips)
    cuts = given.select(*FRAME).distinct()
    report = C.crop_stability(cuts, candidates, A.mosaic_crops(spark, sf_dir), clips)
    return report.withColumn("stability_pct", F.round("stability_pct", 6))
