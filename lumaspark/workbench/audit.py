"""Scoring, consistency rules and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions import transfer as T
from ..operators import checks as K, measure, scoring, scenes as SC
from ..operators.ordered import pick_by_index
from ..session import stage_dir
from ..sources import readers, writers
from . import adapters as A
from . import ordered as W
from .registry import ORACLES, QUERIES, query
from .scalars import six

FRAME = ["clip_id", "frame_idx"]
KEY = "clip_id, frame_idx"

# Scoring ----------------------------------------------------------------------------------
PAIRS_SQL = f"""
    SELECT {KEY}, (our_code + frame_idx * 7 % 5 - 2)::INT AS ref_code, our_code FROM (SELECT {KEY}, {A.sql_pq12(A.sql_nits_to_pq('avg_nits'))} AS our_code FROM ({A.SERIES_SQL}))"""


def ours(spark, sf_dir):
    return A.series(spark, sf_dir).select(*FRAME, T.pq12(T.nits_to_pq("avg_nits")).alias("our_code"))


def reference(spark, sf_dir):
    return ours(spark, sf_dir).select(*FRAME, F.expr("our_code + frame_idx * 7 % 5 - 2").cast("int").alias("ref_code"))


@query("j4_align", f"SELECT {KEY}, our_code, ref_code FROM ({PAIRS_SQL}) WHERE frame_idx % 100 != 99 UNION ALL SELECT {KEY}, our_code, NULL FROM ({PAIRS_SQL}) WHERE frame_idx % 100 = 99")
def j4(spark, sf_dir):
    short = reference(spark, sf_dir).where(F.col("frame_idx") % 100 != 99)
    return scoring.align(ours(spark, sf_dir), short)


@query("j4_count_check", f"""
    SELECT clip_id, count(*) AS ours, count(CASE WHEN frame_idx % 100 != 99 THEN 1 END) AS reference, count(*) = count(CASE WHEN frame_idx % 100 != 99 THEN 1 END) AS agree
    FROM ({PAIRS_SQL}) GROUP BY ALL""")
def j4_counts(spark, sf_dir):
    return scoring.count_check(ours(spark, sf_dir), reference(spark, sf_dir).where(F.col("frame_idx") % 100 != 99))


def _shots(spark, sf_dir):
    cuts = A.series(spark, sf_dir).where((F.col("k") == 7) & (F.col("frame_idx") > 0)).select(*FRAME)
    scenes = SC.scenes_from_cuts(cuts, K.frame_counts(A.series(spark, sf_dir)))
    return scenes.select("clip_id", F.col("scene_id").alias("shot_id"), "start", (F.col("end") + 1).alias("end_excl"))


SHOT_SQL = f"""SELECT p.*, scene_id AS shot_id FROM ({PAIRS_SQL}) p JOIN ({W.RANGES_SQL}) r ON r.clip_id = p.clip_id AND p.frame_idx BETWEEN start AND "end" """


@query("a18_shot_aggregate", f"SELECT clip_id, shot_id, max(our_code) AS top, min(our_code) AS low, round(avg(our_code), 6) AS mean FROM ({SHOT_SQL}) GROUP BY ALL")
def a18(spark, sf_dir):
    shots, series = _shots(spark, sf_dir), ours(spark, sf_dir).withColumnRenamed("our_code", "value")
    parts = [
        scoring.shot_aggregate(series, shots, mode).withColumnRenamed("value", name)
        for mode, name in (("max", "top"), ("min", "low"), ("mean", "mean"))
    ]
    joined = parts[0].join(parts[1], ["clip_id", "shot_id"]).join(parts[2], ["clip_id", "shot_id"])
    return joined.withColumn("mean", F.round("mean", 6))


def stats_sql(pairs: str) -> str:
    nits = f"abs({A.sql_pq_to_nits('(our_code / 4095.0::DOUBLE)')} - {A.sql_pq_to_nits('(ref_code / 4095.0::DOUBLE)')})"
    return f"""
    SELECT clip_id, round(avg(d), 6) AS bias, round(avg(abs(d)), 6) AS mean_abs, max(abs(d)) AS max_abs, round(max(nits), 4) AS worst_nits,
           max(CASE WHEN i = least(floor(n * 0.5::DOUBLE), n - 1) THEN abs(d) END) AS median_abs, max(CASE WHEN i = least(floor(n * 0.95::DOUBLE), n - 1) THEN abs(d) END) AS p95_abs
    FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY abs(d)) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n
          FROM (SELECT clip_id, (our_code - ref_code)::DOUBLE AS d, {nits} AS nits FROM ({pairs}))) GROUP BY ALL"""


def _rounded(stats):
    return stats.withColumns({"bias": F.round("bias", 6), "mean_abs": F.round("mean_abs", 6), "worst_nits": F.round("worst_nits", 4)})


@query("a19_error_stats", stats_sql(PAIRS_SQL))
def a19(spark, sf_dir):
    return _rounded(scoring.score(scoring.align(ours(spark, sf_dir), reference(spark, sf_dir), "inner")))


@query("a19_error_stats_per_shot", stats_sql(f"SELECT clip_id, shot_id, max(ref_code) AS ref_code, max(our_code) AS our_code FROM ({SHOT_SQL}) GROUP BY ALL"))
def a19_shots(spark, sf_dir):
    pairs = scoring.align(ours(spark, sf_dir), reference(spark, sf_dir), "inner")
    return _rounded(scoring.score(pairs, _shots(spark, sf_dir), "max"))


# Errors that are real numbers: a price in place of a code.
REAL_SQL = "SELECT 'n' || (l_suppkey % 4) AS clip_id, l_extendedprice AS v FROM lineitem"


@query("o2_pick_by_index", f"""
    SELECT clip_id, max(CASE WHEN i = n // 2 THEN v END) AS median, max(CASE WHEN i = least(floor(n * 0.95::DOUBLE), n - 1) THEN v END) AS p95, max(CASE WHEN i = 0 THEN v END) AS lowest
    FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM ({REAL_SQL})) GROUP BY ALL""")
def o2(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey") % 4).alias("clip_id"), F.col("l_extendedprice").alias("v"))
    return pick_by_index(rows, ["clip_id"], "v", {
        "median": lambda n: F.floor(n / 2), "p95": lambda n: F.least(F.floor(n * F.lit(0.95)), n - 1), "lowest": lambda n: n * 0,
    })


# Every frame is a cut of one side or both, by its value: a dense list of cuts in which most match at a distance.
MINE, THEIRS = "k % 5 IN (1, 2)", "k % 7 IN (0, 3)"


@query("j5_match_cuts", f"""
    WITH o AS (SELECT {KEY} FROM ({A.SERIES_SQL}) WHERE {MINE}), r AS (SELECT {KEY} FROM ({A.SERIES_SQL}) WHERE {THEIRS} OR NOT {MINE})
    SELECT clip_id, count(CASE WHEN hit THEN 1 END) AS matched, count(*) AS total, (SELECT count(*) FROM o WHERE o.clip_id = q.clip_id) AS ours, round(100.0::DOUBLE * count(CASE WHEN hit THEN 1 END) / count(*), 6) AS recall_pct
    FROM (SELECT r.*, EXISTS (SELECT 1 FROM o WHERE o.clip_id = r.clip_id AND o.frame_idx IN (r.frame_idx - 1, r.frame_idx, r.frame_idx + 1)) AS hit FROM r) q GROUP BY clip_id""")
def j5(spark, sf_dir):
    series = A.series(spark, sf_dir)
    mine = series.where(MINE).select(*FRAME)
    theirs = series.where(f"{THEIRS} OR NOT {MINE}").select(*FRAME)
    return scoring.match_cuts(mine, theirs).withColumn("recall_pct", F.round("recall_pct", 6))


# Two runs over all events; the second has other values, and every fifth user has another name in it.
RUNS_SQL = "SELECT {stem} || user_id || '.bin' AS name, (count(*) + user_id % {step})::INT AS scene_count, round(max(value) + user_id % {step})::INT AS maxcll, round(avg(value) + user_id % {step})::INT AS maxfall FROM events GROUP BY user_id"
BASE_SQL = RUNS_SQL.format(stem="'user'", step=1)
CURRENT_SQL = RUNS_SQL.format(stem="CASE WHEN user_id % 5 = 0 THEN 'other' ELSE 'user' END", step=7)


def _mean(value: str):
    """Mean of doubles that no order of rows changes: they are summed as the decimals they are written as.

    Where one of them has more digits than the sum holds, the mean is the plain one.
    """
    written = F.col(value).try_cast("decimal(28,12)")
    held = F.count(F.when(written.cast("double") == F.col(value), 1)) == F.count(value)
    return F.when(held, F.sum(written).cast("double") / F.count(written)).otherwise(F.avg(value))


def _run(spark, sf_dir, stem, step: int):
    shift = F.col("user_id") % step
    runs = A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), _mean("value").alias("mean"))
    return runs.select(
        F.concat(stem, F.col("user_id"), F.lit(".bin")).alias("name"), (F.col("n") + shift).cast("int").alias("scene_count"),
        F.round(F.col("top") + shift).cast("int").alias("maxcll"), F.round(F.col("mean") + shift).cast("int").alias("maxfall"),
    )


def _two_runs(spark, sf_dir):
    renamed = F.when(F.col("user_id") % 5 == 0, "other").otherwise("user")
    return _run(spark, sf_dir, F.lit("user"), 1), _run(spark, sf_dir, renamed, 7)


@query("j6_pair_runs", f"SELECT name, TRUE AS paired FROM ({BASE_SQL}) JOIN ({CURRENT_SQL}) USING (name) UNION ALL SELECT name, FALSE FROM ({BASE_SQL}) WHERE name NOT IN (SELECT name FROM ({CURRENT_SQL}))")
def j6(spark, sf_dir):
    paired, skipped = scoring.pair_runs(*_two_runs(spark, sf_dir))
    return paired.select("name", F.lit(True).alias("paired")).unionByName(skipped.select("name", F.lit(False).alias("paired")))


@query("j7_header_deltas", f"SELECT name, c.scene_count - b.scene_count AS scene_count_delta, c.maxcll - b.maxcll AS maxcll_delta, c.maxfall - b.maxfall AS maxfall_delta FROM ({BASE_SQL}) b JOIN ({CURRENT_SQL}) c USING (name)")
def j7(spark, sf_dir):
    return scoring.header_deltas(*_two_runs(spark, sf_dir))


def _targets(spark, sf_dir):
    """Two runs; the second one lacks the last frames of every third clip."""
    base = W.series_frames(spark, sf_dir).select(*FRAME, "target_nits")
    shorter = F.substring("clip_id", 2, 1).cast("int") % 3 == 0
    current = base.withColumn("target_nits", F.col("target_nits") + F.col("frame_idx") % 37 - 18).where(~(shorter & (F.col("frame_idx") >= 100)))
    return base, current


_TARGET_SQL = f"SELECT clip_id, frame_idx, target_nits AS a, target_nits + frame_idx % 37 - 18 AS b, NOT (substr(clip_id, 2, 1)::INT % 3 = 0 AND frame_idx >= 100) AS kept FROM ({W.SERIES_FRAMES_SQL})"


@query("a20_target_delta_p95", f"""
    SELECT clip_id, CASE WHEN bool_and(kept) THEN coalesce(max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN d END), 0)::DOUBLE END AS p95, bool_and(kept) AS comparable
    FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM (SELECT *, abs(coalesce(b, 0) - coalesce(a, 0)) AS d FROM ({_TARGET_SQL}))) GROUP BY ALL""")
def a20(spark, sf_dir):
    return scoring.target_delta_p95(*_targets(spark, sf_dir))


# Rules ------------------------------------------------------------------------------------
BENT_SQL = f"""
    SELECT clip_id, scene_id, (start + scene_id % 4 * 300)::INT AS start, ("end" + scene_id % 3 * 100)::INT AS "end" FROM ({W.RANGES_SQL})"""
JUDGED_SQL = f"""SELECT *, "end" < start AS rev, NOT "end" < start AND (start >= frame_count OR "end" >= frame_count) AS outside FROM ({BENT_SQL}) JOIN ({W.COUNTS_SQL}) USING (clip_id)"""


def _bent(spark, sf_dir):
    frames = A.series(spark, sf_dir)
    cuts = frames.where((F.col("k") == 7) & (F.col("frame_idx") > 0)).select(*FRAME)
    scenes = SC.scenes_from_cuts(cuts, K.frame_counts(frames))
    return scenes.select(
        "clip_id", "scene_id", (F.col("start") + F.col("scene_id") % 4 * 300).alias("start"), (F.col("end") + F.col("scene_id") % 3 * 100).alias("end")
    ), frames


@query("v1_scene_ranges", f"""
    SELECT clip_id, scene_id AS item, CASE WHEN rev THEN 'scene_reversed' ELSE 'scene_outside' END AS rule, 'warning' AS severity, start || '-' || "end" AS detail FROM ({JUDGED_SQL}) WHERE rev OR outside""")
def v1(spark, sf_dir):
    return K.check_scene_ranges(*_bent(spark, sf_dir))


@query("v2_scene_coverage", f"""
    SELECT clip_id, NULL::INT AS item, 'scene_coverage' AS rule, 'warning' AS severity, covered || '/' || frame_count AS detail FROM (
      SELECT clip_id, frame_count, sum("end" - start + 1)::BIGINT AS covered FROM ({JUDGED_SQL}) WHERE NOT rev AND NOT outside GROUP BY ALL) WHERE covered != frame_count""")
def v2(spark, sf_dir):
    return K.check_scene_coverage(*_bent(spark, sf_dir))


# Histograms in which some frames are damaged.
def _damaged(spark, sf_dir):
    f = F.col("frame_idx")
    lum = F.when(f % 7 == 3, F.slice("lum_hist", 1, 200)).when(f % 5 == 2, F.transform("lum_hist", lambda v: v * 1.5)).otherwise(F.col("lum_hist"))
    hue = F.when(f % 11 == 1, F.lit(None)).when(f % 7 == 3, F.slice("hue_hist", 1, 30)).when(f % 5 == 2, F.transform("hue_hist", lambda v: v * 1.5)).otherwise(F.col("hue_hist"))
    peak, avg = F.when(f % 13 == 4, F.col("peak_pq") + 1).otherwise(F.col("peak_pq")), F.when(f % 9 == 4, F.col("avg_pq") - 1).otherwise(F.col("avg_pq"))
    return W.measured(spark, sf_dir).withColumns({"lum_hist": lum, "hue_hist": hue, "peak_pq": peak, "avg_pq": avg})


_FRAMES_SQL = f"SELECT DISTINCT {KEY} FROM ({A.SAMPLES_SQL})"
_LUMA_FACTS = f"SELECT {KEY}, max({A.sql_max_rgb()}) AS peak_pq, avg({A.sql_luma()}) AS avg_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL"


@query("v3_lum_hist", f"""
    SELECT clip_id, frame_idx AS item, CASE WHEN frame_idx % 7 = 3 THEN 'lum_hist_length' ELSE 'lum_hist_sum' END AS rule, 'error' AS severity,
           CASE WHEN frame_idx % 7 = 3 THEN '200' ELSE '150.00' END AS detail FROM ({_FRAMES_SQL}) WHERE frame_idx % 7 = 3 OR frame_idx % 5 = 2""")
def v3(spark, sf_dir):
    return K.check_lum_hist(_damaged(spark, sf_dir))


@query("v4_hue_hist", f"""
    SELECT clip_id, frame_idx AS item, CASE WHEN frame_idx % 7 = 3 THEN 'hue_hist_length' ELSE 'hue_hist_sum' END AS rule, 'warning' AS severity,
           CASE WHEN frame_idx % 7 = 3 THEN '30' ELSE '150.00' END AS detail FROM ({_FRAMES_SQL}) WHERE frame_idx % 11 != 1 AND (frame_idx % 7 = 3 OR frame_idx % 5 = 2)""")
def v4(spark, sf_dir):
    return K.check_hue_hist(_damaged(spark, sf_dir))


@query("a25_hue_coverage", f"""
    SELECT clip_id, count(*) AS frames, count(CASE WHEN frame_idx % 11 != 1 THEN 1 END) AS with_hue, count(CASE WHEN frame_idx % 11 != 1 AND frame_idx % 7 != 3 THEN 1 END) AS with_color,
           round(count(CASE WHEN frame_idx % 11 != 1 AND frame_idx % 7 != 3 THEN 1 END) * 100.0::DOUBLE / count(CASE WHEN frame_idx % 11 != 1 THEN 1 END), 6) AS pct, FALSE AS warn FROM ({_FRAMES_SQL}) GROUP BY clip_id""")
def a25(spark, sf_dir):
    return K.hue_coverage(_damaged(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query("v5_pq_range", f"""
    SELECT clip_id, frame_idx AS item, CASE WHEN peak_pq > 1 THEN 'peak_pq_range' ELSE 'avg_pq_range' END AS rule, 'error' AS severity, printf('%.4f', CASE WHEN peak_pq > 1 THEN peak_pq ELSE avg_pq END) AS detail
    FROM (SELECT {KEY}, CASE WHEN frame_idx % 13 = 4 THEN peak_pq + 1 ELSE peak_pq END AS peak_pq, CASE WHEN frame_idx % 9 = 4 THEN avg_pq - 1 ELSE avg_pq END AS avg_pq FROM ({_LUMA_FACTS})) WHERE peak_pq > 1 OR avg_pq < 0""")
def v5(spark, sf_dir):
    return K.check_pq_range(_damaged(spark, sf_dir))


_BENT_HEADER_SQL = f"""
    SELECT h.clip_id, maxfall + substr(h.clip_id, 2, 1)::INT % 3 * 40 AS maxfall, avgfall + substr(h.clip_id, 2, 1)::INT % 2 * 30 AS avgfall, substr(h.clip_id, 2, 1)::INT % 2 + 2 AS flags, mx, av FROM ({W.FALL_SQL}) h
    JOIN (SELECT clip_id, max(n) AS mx, avg(n) AS av FROM (SELECT clip_id, {A.sql_pq_to_nits('avg_pq')} AS n FROM ({W.SERIES_FRAMES_SQL})) GROUP BY ALL) d ON h.clip_id = d.clip_id"""


def _bent_headers(spark, sf_dir):
    no = F.substring("clip_id", 2, 1).cast("int")
    return W.series_headers(spark, sf_dir, 5).withColumns({
        "maxfall": F.col("maxfall") + no % 3 * 40, "avgfall": F.col("avgfall") + no % 2 * 30, "flags": no % 2 + 2,
    })


@query("v6_fall", f"""
    SELECT clip_id, NULL::INT AS item, 'maxfall' AS rule, 'warning' AS severity, printf('header=%d derived=%.0f', maxfall, mx) AS detail FROM ({_BENT_HEADER_SQL}) WHERE abs(mx - maxfall) > greatest(10, mx * 0.02)
    UNION ALL SELECT clip_id, NULL, 'avgfall', 'warning', printf('header=%d derived=%.0f', avgfall, av) FROM ({_BENT_HEADER_SQL}) WHERE abs(av - avgfall) > greatest(10, av * 0.02)""")
def v6(spark, sf_dir):
    return K.check_fall(_bent_headers(spark, sf_dir), W.series_frames(spark, sf_dir))


@query("v7_flags", f"""
    SELECT clip_id, NULL::INT AS item, CASE WHEN flags = 3 THEN 'targets_missing' ELSE 'targets_unexpected' END AS rule, 'warning' AS severity, w || '/' || n AS detail FROM ({_BENT_HEADER_SQL})
    JOIN (SELECT clip_id, count(*) AS n, count(target_nits) AS w FROM ({W.SERIES_FRAMES_SQL}) GROUP BY ALL) USING (clip_id) WHERE (flags = 3 AND w < n) OR (flags != 3 AND w > 0)""")
def v7(spark, sf_dir):
    return K.check_flags(_bent_headers(spark, sf_dir), W.series_frames(spark, sf_dir))


# Exported per-frame documents, one clip per event, with parts missing by formula.
EXPORT_SQL = """SELECT 'v' || event_id AS clip_id, 0 AS frame_idx, (props->>'k')::INT AS k, event_id FROM events"""


def _doc_columns(k, e):
    """The document as JSON text, assembled from its parts."""
    l1 = F.format_string('{"Level1":{"min_pq":%d,"avg_pq":%d,"max_pq":%d}}', k % 50, k * 20 + F.when(e % 17 == 0, 3000).otherwise(0), k * 20 + 500)
    l5 = F.format_string('{"Level5":{"active_area_left_offset":%d,"active_area_right_offset":%d,"active_area_top_offset":%d,"active_area_bottom_offset":%d}}', k % 3, k % 4, k, k + 1)
    l6 = F.format_string('{"Level6":{"max_display_mastering_luminance":%d,"min_display_mastering_luminance":1,"max_content_light_level":%d,"max_frame_average_light_level":200}}', (k % 4) * 1000, k * 10)
    cmv29 = F.concat_ws(",", F.when(e % 7 != 0, l1), F.when(e % 3 == 0, l5), F.when(e % 11 != 0, l6))
    l9, l11, l254 = F.lit('{"Level9":{"source_primary_index":0}}'), F.lit('{"Level11":{"content_type":1,"reference_mode_flag":false}}'), F.format_string('{"Level254":{"dm_mode":0,"dm_version_index":%d}}', F.lit(2) + (e % 19 == 0).cast("int"))
    cmv40 = F.concat_ws(",", F.when(e % 5 != 0, l9), F.when(e % 13 != 0, l11), l254, F.when(e % 2 == 0, F.lit('{"Level8":{"length":10}}')))
    return F.format_string(
        '{"dovi_profile":%d,"vdr_dm_data":{"cmv29_metadata":{"ext_metadata_blocks":[%s]},"cmv40_metadata":{"ext_metadata_blocks":[%s]}}}',
        F.when(e % 23 == 0, 7).otherwise(8), cmv29, cmv40,
    )


def exported(spark, sf_dir, per_clip: int = 1):
    """Documents of ``per_clip`` frames per clip."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    rows = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.floor(e / per_clip)).alias("clip_id"), (e % per_clip).cast("int").alias("frame_idx"), _doc_columns(k, e).alias("doc_json")
    )
    return rows.withColumn("doc", F.from_json("doc_json", schemas.EXPORTED))


def _broken_sql(rule: str, condition: str) -> str:
    return f"SELECT clip_id, NULL::INT AS item, '{rule}' AS rule, 'error' AS severity, '' AS detail FROM ({EXPORT_SQL}) WHERE {condition}"


@query("v8_metadata", " UNION ALL ".join(
    _broken_sql(rule, condition)
    for rule, condition in (
        ("profile", "event_id % 23 = 0"), ("l1_missing", "event_id % 7 = 0"),
        ("l1_order", "event_id % 7 != 0 AND (event_id % 17 = 0 OR k % 50 > k * 20)"), ("l6_missing", "event_id % 11 = 0"),
        ("l6_max_display_mastering_luminance", "event_id % 11 != 0 AND k % 4 = 0"), ("l6_max_content_light_level", "event_id % 11 != 0 AND k = 0"),
        ("l9_missing", "event_id % 5 = 0"), ("l11_missing", "event_id % 13 = 0"), ("l254_version", "event_id % 19 = 0"),
    )))
def v8(spark, sf_dir):
    return K.check_metadata(exported(spark, sf_dir))


@query("v9_duration", """
    SELECT 'v' || event_id AS clip_id, NULL::INT AS item, 'duration' AS rule, 'error' AS severity, printf('%.2f/%.2f', value::DOUBLE, value + (event_id % 5) * 0.5::DOUBLE) AS detail FROM events WHERE abs(value - (value + (event_id % 5) * 0.5::DOUBLE)) > 1.0""")
def v9(spark, sf_dir):
    source = A.table(spark, sf_dir, "events").select(F.concat(F.lit("v"), F.col("event_id")).alias("clip_id"), F.col("value").alias("duration_s"), "event_id")
    output = source.select("clip_id", (F.col("duration_s") + F.col("event_id") % 5 * F.lit(0.5)).alias("duration_s"))
    return K.check_duration(source, output)


def _sidecars(spark, sf_dir):
    crops = A.series(spark, sf_dir).select("clip_id").distinct().select(
        "clip_id", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(40).alias("width"), F.lit(40).alias("height")).alias("rect")
    )
    path = f"{stage_dir(spark)}/lumaspark-sidecars-{uuid.uuid4().hex}"
    writers.write_sidecar(W.series_frames(spark, sf_dir), crops, path)
    return readers.read_sidecar_documents(spark, path)


@query("v10_counts", f"""
    SELECT clip_id, NULL::INT AS item, 'sidecar_' || c AS rule, 'error' AS severity, n || '/' || (n - 5) AS detail FROM (SELECT clip_id, count(*) AS n FROM ({A.SERIES_SQL}) GROUP BY ALL), (VALUES ('min_pq_12bit'), ('avg_luma_pq_12bit'), ('avg_max_rgb_pq_12bit')) v(c)""")
def v10(spark, sf_dir):
    shorter = W.series_frames(spark, sf_dir).where(F.col("frame_idx") >= 5)
    return K.check_counts(shorter, _sidecars(spark, sf_dir))


# Shot lists per clip, a shot for every frame: good for some clips, with one fault in others.
LINES_SQL = f"""
    SELECT clip_id, frame_idx AS line_no, CASE WHEN no = 1 AND frame_idx = 0 THEN '5' WHEN no = 2 AND frame_idx = 100 THEN '20' WHEN no = 3 THEN (frame_idx + 100000)::VARCHAR ELSE frame_idx::VARCHAR END AS value, no, frame_idx
    FROM (SELECT *, event_id % 8 AS no FROM ({A.SERIES_SQL}))"""
SENTINEL_SQL = f"SELECT clip_id, frame_count FROM ({W.COUNTS_SQL})"


def shot_lines(spark, sf_dir):
    """Text lines with a sentinel at the end and a blank line in between."""
    frames = A.series(spark, sf_dir)
    no = F.col("event_id") % 8
    f = F.col("frame_idx")
    value = F.when((no == 1) & (f == 0), F.lit(5)).when((no == 2) & (f == 100), F.lit(20)).when(no == 3, f + 100000).otherwise(f)
    lines = frames.select("clip_id", f.cast("bigint").alias("line_no"), F.concat(F.lit(" "), value.cast("string")).alias("value"))
    counts = K.frame_counts(frames)
    # Every clip has one line per frame, so these come after all of them.
    sentinels = counts.select("clip_id", (F.col("frame_count") + 1).cast("bigint").alias("line_no"), F.col("frame_count").cast("string").alias("value"))
    blanks = counts.select("clip_id", F.col("frame_count").cast("bigint").alias("line_no"), F.lit("  ").alias("value"))
    return lines.unionByName(sentinels).unionByName(blanks), counts


@query("s5_shot_list", f"""
    SELECT clip_id, (row_number() OVER w - 1)::INT AS shot_id, frame_idx AS start, coalesce(lead(frame_idx) OVER w, frame_count)::INT AS end_excl
    FROM ({LINES_SQL}) JOIN ({W.COUNTS_SQL}) USING (clip_id) WHERE no NOT IN (1, 2, 3) AND frame_idx < frame_count WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)""")
def s5(spark, sf_dir):
    lines, counts = shot_lines(spark, sf_dir)
    return readers.shots_from_starts(readers.shot_starts(lines), counts, check=False)


@query("v11_shot_rules", f"""
    WITH l AS (SELECT clip_id, (row_number() OVER w - 1)::INT AS line, value::INT AS start, lag(value::INT) OVER w AS before, lead(line_no) OVER w IS NULL AS final FROM ({LINES_SQL}) WINDOW w AS (PARTITION BY clip_id ORDER BY line_no))
    SELECT clip_id, line AS item, 'shots_first' AS rule, 'error' AS severity, start::VARCHAR AS detail FROM l WHERE line = 0 AND start <> 0
    UNION ALL SELECT clip_id, line, 'shots_order', 'error', start::VARCHAR FROM l WHERE before >= start
    UNION ALL SELECT clip_id, line, 'shots_outside', 'error', start::VARCHAR FROM l JOIN ({W.COUNTS_SQL}) USING (clip_id) WHERE final AND start >= frame_count""")
def v11(spark, sf_dir):
    lines, counts = shot_lines(spark, sf_dir)
    return K.check_shots(readers.shot_starts(lines), counts)


@query("v12_domains", f"""
    SELECT r.clip_id, r.frame_idx AS item, 'domain_order' AS rule, 'error' AS severity, '' AS detail FROM (SELECT {KEY}, max({A.sql_max_rgb()}) AS p FROM ({A.SAMPLES_SQL}) GROUP BY ALL) r
    JOIN (SELECT {KEY}, max({A.sql_luma()}) + max((frame_idx % 40 = 7)::INT) AS l FROM ({A.SAMPLES_SQL}) GROUP BY clip_id, frame_idx) l USING (clip_id, frame_idx) WHERE p < l - 0.25 / 4095""")
def v12(spark, sf_dir):
    given = A.samples(spark, sf_dir)
    levels = measure.frame_levels(given)
    scened = levels.withColumn("scene_id", F.expr("frame_idx div 30"))
    luma = F.col("max_luma") + (F.col("frame_idx") % 40 == 7).cast("int")
    return K.check_domains(scened.withColumnRenamed("max_rgb", "peak_pq"), levels.withColumn("peak_pq", luma))


@query("v12_bias", f"SELECT clip_id, NULL::INT AS item, 'bias' AS rule, 'error' AS severity, printf('%.1f', b) AS detail FROM (SELECT clip_id, avg(our_code * (1 + substr(clip_id, 2, 1)::INT % 2 * 0.05) - ref_code) AS b FROM ({PAIRS_SQL}) GROUP BY ALL) WHERE abs(b) > 25")
def v12_bias(spark, sf_dir):
    no = F.substring("clip_id", 2, 1).cast("int")
    pairs = scoring.align(ours(spark, sf_dir), reference(spark, sf_dir), "inner").withColumn("our_code", F.col("our_code") * (F.lit(1) + no % 2 * F.lit(0.05)))
    return K.check_bias(scoring.error_stats(pairs))


RULE_QUERIES = (
    "v1_scene_ranges", "v2_scene_coverage", "v3_lum_hist", "v4_hue_hist", "v5_pq_range", "v6_fall", "v7_flags", "v8_metadata", "v9_duration",
    "v10_counts", "v11_shot_rules", "v12_domains", "v12_bias",
)


@query("o6_all_violations", "SELECT rule, severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT rule, severity FROM ({ORACLES[name]})" for name in RULE_QUERIES) + ") GROUP BY ALL")
def o6(spark, sf_dir):
    """All twelve rule families together."""
    every = K.all_violations(*[QUERIES[name](spark, sf_dir) for name in RULE_QUERIES])
    return every.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
