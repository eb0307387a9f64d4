"""Container metadata, generated metadata, side files and file formats."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..functions import transfer as T
from ..operators import grain, measure, metadata as M, rollups, samples as S, scoring
from ..session import stage_dir, staged
from ..sources import catalog, ordered_text, raw_video, readers, writers
from . import adapters as A
from . import audit, ordered as W
from .pixels import LUM_SQL, MOSAIC_FINE_SQL, MOSAIC_TAILS, mosaic_parts, mosaic_planes, robust_sql
from .registry import query
from .scalars import six

FRAME = ["clip_id", "frame_idx"]
KEY = "clip_id, frame_idx"
EVENTS_SQL = "SELECT 'v' || event_id AS clip_id, event_id AS e, (props->>'k')::INT AS k, value FROM events"


def scratch(spark, label: str) -> str:
    return f"{stage_dir(spark)}/lumaspark-{label}-{uuid.uuid4().hex}"


def events(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.col("event_id")).alias("clip_id"), F.col("event_id").alias("e"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value"
    )


def tracks(spark, sf_dir):
    """One container document per event, with fields that come and go by formula."""
    e, k = F.col("e"), F.col("k")
    field = lambda name, value, there: F.when(there, F.concat(F.lit(f'"{name}":"'), value, F.lit('"')))
    fmt = F.element_at(F.array(*[F.lit(v) for v in ("SMPTE ST 2094 App 4", "SMPTE ST 2086", "Dolby Vision", "", "")]), k % 5 + 1)
    transfer = F.element_at(F.array(F.lit("PQ"), F.lit("HLG"), F.lit("BT.709")), (e % 3 + 1).cast("int"))
    primaries = F.element_at(
        F.array(F.lit("Display P3"), F.lit("BT.2020"), F.lit("G(x=0.1700, y=0.7970)B(0.1310,0.0460)R(x=0.7080,y=0.2920)WP(0.3127,0.3290)"), F.lit("")), (e % 4 + 1).cast("int")
    )
    fields = F.concat_ws(
        ",",
        F.lit('"@type":"Video"'),
        field("HDR_Format", fmt, k % 5 != 3),
        field("HDR_Format_Profile", F.when(e % 2 == 0, "dvhe.08").otherwise("dvhe.07"), k % 5 == 2),
        field("transfer_characteristics", transfer, F.lit(True)),
        field("MasteringDisplay_Luminance", F.format_string("min: 0.00%d cd/m2, max: %d cd/m2", k % 9 + 1, (k + 10) * 10), e % 4 != 3),
        field("MasteringDisplay_ColorPrimaries", primaries, e % 4 != 3),
        field("colour_primaries", F.when(e % 2 == 0, "BT.709").otherwise("BT.2020"), F.lit(True)),
        F.when(e % 3 == 0, F.format_string('"MaxCLL":%d', k + 100)),
        field("MaxCLL", F.format_string("%d cd/m2", k + 200), e % 3 == 1),
        field("MaxFALL", k.cast("string"), e % 5 != 0),
        field("Duration", (e * 37).cast("string"), e % 6 != 0),
        F.when(e % 6 == 0, F.format_string('"Duration":%d.5', e)),
    )
    document = F.concat(F.lit('{"media":{"track":[{"@type":"General","HDR_Format":"HDR10+","Duration":"1"},{'), fields, F.lit("}]}}"))
    return events(spark, sf_dir).select("clip_id", "e", "k", document.alias("track_json"))


# Tracks -----------------------------------------------------------------------------------
@query("s11_container_metadata", f"SELECT clip_id, 1 AS ord, (['PQ', 'HLG', 'BT.709'])[e % 3 + 1] AS transfer FROM ({EVENTS_SQL})")
def s11(spark, sf_dir):
    return M.video_tracks(tracks(spark, sf_dir)).select("clip_id", "ord", F.col("track")["transfer_characteristics"].alias("transfer"))


HINTS_SQL = f"""SELECT clip_id, e, k, concat_ws(chr(10), CASE WHEN k % 5 != 3 THEN (['SMPTE ST 2094 App 4', 'SMPTE ST 2086', 'Dolby Vision', '', ''])[k % 5 + 1] END,
    CASE WHEN k % 5 = 2 THEN CASE WHEN e % 2 = 0 THEN 'dvhe.08' ELSE 'dvhe.07' END END, (['PQ', 'HLG', 'BT.709'])[e % 3 + 1]) AS hints FROM ({EVENTS_SQL})"""


@query("m2_gather_hints", f"SELECT clip_id, hints FROM ({HINTS_SQL})")
def m2(spark, sf_dir):
    return M.gather_hints(tracks(spark, sf_dir))


_BY_HINT = """CASE WHEN k % 5 = 0 THEN 'hdr10plus' WHEN e % 3 = 1 THEN 'hlg' WHEN e % 3 = 0 THEN CASE WHEN e % 7 = 0 THEN 'hdr10_with_measurements' ELSE 'hdr10_unsupported' END END"""


@query("m1_classify_hints", f"SELECT clip_id, {_BY_HINT} AS format FROM ({EVENTS_SQL})")
def m1(spark, sf_dir):
    hints = M.gather_hints(tracks(spark, sf_dir)).join(events(spark, sf_dir), "clip_id")
    return hints.select("clip_id", X.classify_hints("hints", F.col("e") % 7 == 0).alias("format"))


def side(spark, sf_dir):
    e = F.col("e")
    layer = F.when(e % 8 == 1, "profile7_mel").when(e % 8 == 2, "other")
    return events(spark, sf_dir).select(
        "clip_id", layer.alias("layer_kind"), F.when(e % 4 == 0, "smpte2084").alias("color_transfer"), (e % 7 == 0).alias("has_measurements")
    )


@query("m3_classify_format", f"""
    SELECT clip_id, CASE WHEN k % 5 = 2 AND e % 2 = 0 THEN 'dolby_vision_p8' WHEN k % 5 = 2 THEN CASE WHEN e % 8 = 1 THEN 'dolby_vision_mel' ELSE 'dolby_vision_fel' END
        WHEN e % 8 = 1 THEN 'dolby_vision_mel' WHEN e % 8 = 2 THEN 'unsupported'
        ELSE coalesce({_BY_HINT}, CASE WHEN e % 4 = 0 THEN CASE WHEN e % 7 = 0 THEN 'hdr10_with_measurements' ELSE 'hdr10_unsupported' END END, 'unsupported') END AS format FROM ({EVENTS_SQL})""")
def m3(spark, sf_dir):
    return M.classify_format(tracks(spark, sf_dir), side(spark, sf_dir))


def details(spark, sf_dir):
    text = F.format_string("Report\nmaxcll : %d,5\nMaxFALL: %d.25 nits\n", F.col("k") + 300, F.col("k") + 10)
    return events(spark, sf_dir).where(F.col("e") % 10 == 0).select("clip_id", text.alias("detail_text"))


STATIC_SQL = f"""
    SELECT clip_id, e, k, CASE WHEN e % 4 != 3 THEN ((k + 10) * 10)::DOUBLE END AS max_dml, CASE WHEN e % 4 != 3 THEN (k % 9 + 1) / 1000.0::DOUBLE END AS min_dml,
           CASE WHEN e % 10 = 0 THEN k + 300.5::DOUBLE WHEN e % 3 = 0 THEN (k + 100)::DOUBLE WHEN e % 3 = 1 THEN (k + 200)::DOUBLE END AS max_cll,
           CASE WHEN e % 10 = 0 THEN k + 10.25::DOUBLE WHEN e % 5 != 0 THEN k::DOUBLE END AS max_fall, e % 4 = 2 AS md FROM ({EVENTS_SQL})"""
_MD = {"md_gx": 8500, "md_gy": 39850, "md_bx": 6550, "md_by": 2300, "md_rx": 35400, "md_ry": 14600, "md_wpx": 15635, "md_wpy": 16450}


@query("m4_static_metadata", f"SELECT clip_id, max_dml, min_dml, max_cll, max_fall, {', '.join(f'CASE WHEN md THEN {v} END AS {n}' for n, v in _MD.items())} FROM ({STATIC_SQL})")
def m4(spark, sf_dir):
    return M.static_metadata(tracks(spark, sf_dir), details(spark, sf_dir))


DEFAULTED_SQL = f"""SELECT clip_id, e, k, md, coalesce(max_dml, 1000.0) AS max_dml, coalesce(min_dml, 0.005) AS min_dml, coalesce(max_cll, 1000.0) AS max_cll, coalesce(max_fall, 400.0) AS max_fall,
    concat_ws(',', CASE WHEN max_dml IS NULL THEN 'max_dml' END, CASE WHEN min_dml IS NULL THEN 'min_dml' END, CASE WHEN max_cll IS NULL THEN 'max_cll' END, CASE WHEN max_fall IS NULL THEN 'max_fall' END) AS defaulted FROM ({STATIC_SQL})"""


def defaulted(spark, sf_dir):
    return M.with_defaults(M.static_metadata(tracks(spark, sf_dir), details(spark, sf_dir)))


@query("m5_defaults", f"SELECT clip_id, max_dml::DOUBLE AS max_dml, min_dml::DOUBLE AS min_dml, max_cll::DOUBLE AS max_cll, max_fall::DOUBLE AS max_fall, defaulted FROM ({DEFAULTED_SQL})")
def m5(spark, sf_dir):
    return defaulted(spark, sf_dir).select("clip_id", "max_dml", "min_dml", "max_cll", "max_fall", F.array_join("defaulted", ",").alias("defaulted"))


# Chromaticity text in both notations, with one point missing in some rows.
@query("m6_parse_primaries", f"""
    SELECT clip_id, CASE WHEN e % 5 != 0 THEN least(k * 500, 50000)::INT END AS md_gx, CASE WHEN e % 5 != 0 THEN 39850 END AS md_gy, CASE WHEN e % 5 != 0 THEN 6550 END AS md_bx,
           CASE WHEN e % 5 != 0 THEN 16450 END AS md_wpy FROM ({EVENTS_SQL})""")
def m6(spark, sf_dir):
    k = F.col("k")
    g = F.when(F.col("e") % 2 == 0, F.format_string("G(x=%.4f, y=0.7970)", k / F.lit(100.0))).otherwise(F.format_string("G(%.4f,0.7970)", k / F.lit(100.0)))
    wp = F.when(F.col("e") % 5 != 0, "WP(x=0.3127, y=0.3290)").otherwise("")
    parsed = X.parse_primaries(F.concat(g, F.lit("B(0.1310,0.0460)R(0.7080,0.2920)"), wp))
    return events(spark, sf_dir).select("clip_id", parsed.alias("p")).select("clip_id", *[F.col(f"p.{n}").alias(n) for n in ("md_gx", "md_gy", "md_bx", "md_wpy")])


@query("m7_primaries_index", f"SELECT clip_id, CASE WHEN e % 4 = 0 THEN 0 WHEN e % 4 = 1 THEN 2 WHEN e % 2 = 0 THEN 1 ELSE 2 END AS primary_index FROM ({EVENTS_SQL})")
def m7(spark, sf_dir):
    return M.source_primaries(tracks(spark, sf_dir))


@query("m8_l6_block", f"""
    SELECT clip_id, trunc(max_dml)::INT AS a, trunc(min_dml::DOUBLE * 10000)::INT AS b, trunc(max_cll)::INT AS c, trunc(max_fall)::INT AS d FROM ({DEFAULTED_SQL})""")
def m8(spark, sf_dir):
    block = defaulted(spark, sf_dir).select("clip_id", X.l6_block("max_dml", "min_dml", "max_cll", "max_fall").alias("b")).select("clip_id", "b.*")
    names = ("max_display_mastering_luminance", "min_display_mastering_luminance", "max_content_light_level", "max_frame_average_light_level")
    return block.select("clip_id", *[F.col(n).alias(c) for n, c in zip(names, "abcd")])


@query("m9_trim_blocks", f"""
    SELECT clip_id, i::INT AS i, round({A.sql_nits_to_pq('nits')} * 4095)::INT AS target_max_pq, 2048 * 6 AS neutral FROM (
      SELECT clip_id, unnest(range(3)) AS i, unnest([100, 600 + k, 1000]) AS nits FROM ({EVENTS_SQL}))""")
def m9(spark, sf_dir):
    text = F.concat(F.lit("100, x,"), (F.col("k") + 600).cast("string"), F.lit(" ,,1000"))
    blocks = X.trim_blocks(X.trim_targets(text))
    rows = events(spark, sf_dir).select("clip_id", F.posexplode(blocks).alias("i", "b"))
    total = sum((F.col(f"b.{n}") for n in ("trim_slope", "trim_offset", "trim_power", "trim_chroma_weight", "trim_saturation_gain", "ms_weight")), F.lit(0))
    return rows.select("clip_id", "i", "b.target_max_pq", total.alias("neutral"))


@query("m10_l9_l11_l5_blocks", f"""
    SELECT clip_id, '{{"length":1,"source_primary_index":' || (k % 3) || '}}' AS l9, '{{"content_type":1,"whitepoint":0,"reference_mode_flag":false}}' AS l11,
           '{{"active_area_left_offset":' || (k % 3) || ',"active_area_right_offset":' || (k % 4) || ',"active_area_top_offset":' || k || ',"active_area_bottom_offset":' || (k + 1) || '}}' AS l5 FROM ({EVENTS_SQL})""")
def m10(spark, sf_dir):
    offsets = F.struct((F.col("k") % 3).alias("left"), (F.col("k") % 4).alias("right"), F.col("k").alias("top"), (F.col("k") + 1).alias("bottom"))
    return events(spark, sf_dir).select(
        "clip_id", F.to_json(X.l9_block(F.col("k") % 3)).alias("l9"), F.to_json(X.l11_block()).alias("l11"), F.to_json(X.l5_block(offsets)).alias("l5")
    )


@query("m11_shots_from_scenes", f"""
    SELECT clip_id, start, "end" - start + 1 AS duration, min_pq_12bit AS min_pq, max_pq_12bit AS max_pq, avg_max_rgb_pq_12bit AS avg_pq, max("end") OVER (PARTITION BY clip_id) + 1 AS length FROM ({W.SCENE_L1_SQL})""")
def m11(spark, sf_dir):
    scene_l1 = rollups.scene_l1(W.series_frames(spark, sf_dir))
    packed = M.shots_from_scenes(scene_l1).select("clip_id", "length", F.explode("shots").alias("s"))
    l1 = F.get("s.metadata_blocks", 0)["Level1"]
    return packed.select("clip_id", "s.start", "s.duration", l1["min_pq"].alias("min_pq"), l1["max_pq"].alias("max_pq"), l1["avg_pq"].alias("avg_pq"), "length")


@query("m11_shot_rows", f"""SELECT clip_id, start, "end" - start + 1 AS duration, min_pq_12bit AS min_pq, max_pq_12bit AS max_pq, avg_max_rgb_pq_12bit AS avg_pq FROM ({W.SCENE_L1_SQL})""")
def m11_rows(spark, sf_dir):
    return M.shot_rows(rollups.scene_l1(W.series_frames(spark, sf_dir)))


def summaries(spark, sf_dir, shift: int):
    k, e = F.col("k") + shift, F.col("e")
    text = F.format_string(
        "Summary:\n  Frames: %d\n  Profile: 8\n  DM version: 2 (CM v4.0)\n  Scene/shot count: %d\n  RPU mastering display: 0.0001/1000 nits\n"
        "  RPU content light level (L1): MaxCLL: %d.50 nits, MaxFALL: %d.25 nits\n  L6 metadata: %d\n", e + 10, k, k * 9, k * 2, k,
    )
    return events(spark, sf_dir).select("clip_id", text.alias("summary_text"))


@query("m12_regeneration_report", f"""
    SELECT clip_id, e + 10 AS old_frames, k AS old_scene_count, k + 3 AS new_scene_count, '2 (CM v4.0)' AS old_dm_version, (k + 3)::VARCHAR AS new_l6, (e + 12)::INT - (e + 10)::INT AS frame_delta, k * 2 - k AS scene_delta,
           (k * 10)::DOUBLE - (k * 9 + 0.5::DOUBLE) AS maxcll_delta, (k * 3)::DOUBLE - (k * 2 + 0.25::DOUBLE) AS maxfall_delta, CASE WHEN k > 50 THEN (k * 8)::DOUBLE END AS measured_avg_target_nits FROM ({EVENTS_SQL})""")
def m12(spark, sf_dir):
    k, e = F.col("k"), F.col("e")
    base = F.format_string("=== FILE SUMMARY ===\nScenes: %d\nFrames: %d\nMax Peak PQ: 0.7500 (%d nits)\nAvg Peak PQ: 0.5000 (%d nits)\nMax Avg PQ: 0.4000 (%d nits)\n", k * 2, e + 12, k * 10, k * 5, k * 3)
    text = F.concat(base, F.when(k > 50, F.format_string("Average target nits: %d\n", k * 8)).otherwise(""))
    measured = events(spark, sf_dir).select("clip_id", text.alias("summary_text"))
    report = M.regeneration_report(summaries(spark, sf_dir, 0), summaries(spark, sf_dir, 3), measured)
    return report.select(
        "clip_id", F.col("old_frames").cast("bigint").alias("old_frames"), "old_scene_count", "new_scene_count", "old_dm_version", "new_l6",
        "frame_delta", "scene_delta", "maxcll_delta", "maxfall_delta", "measured_avg_target_nits",
    )


@query("o4_level_diff", f"""
    SELECT clip_id, CASE WHEN e % 2 = 0 THEN '' ELSE 'Level8' END AS added, concat_ws(',', CASE WHEN e % 13 = 0 THEN 'Level11' END, CASE WHEN e % 5 = 0 THEN 'Level9' END) AS missing FROM ({EVENTS_SQL})""")
def o4(spark, sf_dir):
    documents = audit.exported(spark, sf_dir)
    old = M.level_sets(documents)
    new = old.withColumn("levels", F.array_union("levels", F.array(F.lit("Level8"))))
    return M.level_diff(old, new)


@query("m13_warning_text", f"SELECT clip_id, CASE WHEN reasons != '' THEN reasons END AS warning FROM ({W.HEALTH_SQL})")
def m13(spark, sf_dir):
    return W.health(spark, sf_dir).select("clip_id", X.warning_text("reasons").alias("warning"))


_FRAME_DOCS = "SELECT 'v' || (event_id // 25) AS clip_id, (event_id % 25)::INT AS frame_idx, (props->>'k')::INT AS k, event_id AS e FROM events"


@query("m14_l1_from_export", f"SELECT clip_id, frame_idx, k % 50 AS min_pq, (k * 20 + CASE WHEN e % 17 = 0 THEN 3000 ELSE 0 END)::INT AS avg_pq, k * 20 + 500 AS max_pq FROM ({_FRAME_DOCS}) WHERE e % 7 != 0")
def m14(spark, sf_dir):
    return M.l1_from_export(audit.exported(spark, sf_dir, 25))


@query("m14_clip_facts", f"""
    SELECT clip_id, min_by(k % 3, CASE WHEN e % 3 = 0 THEN frame_idx END) AS "left", min_by(k % 4, CASE WHEN e % 3 = 0 THEN frame_idx END) AS "right", min_by(k, CASE WHEN e % 3 = 0 THEN frame_idx END) AS top,
           min_by(k + 1, CASE WHEN e % 3 = 0 THEN frame_idx END) AS bottom, round({A.sql_nits_to_pq('min_by(k % 4 * 1000, CASE WHEN e % 11 != 0 THEN frame_idx END)')} * 4095)::INT AS mastering_peak_pq FROM ({_FRAME_DOCS}) GROUP BY clip_id""")
def m14_facts(spark, sf_dir):
    return M.clip_facts_from_export(audit.exported(spark, sf_dir, 25))


@query("m15_layer_kind", f"""
    SELECT clip_id, CASE WHEN e % 4 < 2 THEN CASE WHEN k % 3 = 0 THEN 'profile7_mel' ELSE 'profile7_fel' END WHEN e % 4 = 2 THEN 'profile8' ELSE 'other' END AS kind FROM ({EVENTS_SQL})""")
def m15(spark, sf_dir):
    profile = F.element_at(F.array(F.lit(7), F.lit(7), F.lit(8), F.lit(5)), (F.col("e") % 4 + 1).cast("int"))
    el = F.when(F.col("k") % 3 == 0, "MEL").when(F.col("k") % 3 == 1, "FEL")
    return events(spark, sf_dir).select("clip_id", X.layer_kind(profile, el).alias("kind"))


@query("m16_mastering_display_text", f"""
    SELECT clip_id, 'G(8500,39850)B(6550,2300)R(35400,14600)WP(15635,16450)L(' || (trunc(max_dml)::INT * 10000) || ',' || trunc(min_dml::DOUBLE * 10000)::INT || ')' AS master_display,
           trunc(max_cll)::INT AS max_cll, trunc(max_fall)::INT AS max_fall FROM ({DEFAULTED_SQL})""")
def m16(spark, sf_dir):
    return M.hdr10_text(M.static_metadata(tracks(spark, sf_dir), details(spark, sf_dir)))


@query("m17_number_after", f"SELECT clip_id, (e + 10)::DOUBLE AS frames, k::DOUBLE AS scenes, NULL::DOUBLE AS nothing FROM ({EVENTS_SQL})")
def m17(spark, sf_dir):
    text = F.col("summary_text")
    return summaries(spark, sf_dir, 0).select(
        "clip_id", X.number_after(text, "Frames:").alias("frames"), X.number_after(text, "Scene/shot count:").alias("scenes"), X.number_after(text, "No such label:").alias("nothing")
    )


@query("m18_frame_rate", f"""
    SELECT clip_id, CASE WHEN e % 4 = 1 THEN 24000 WHEN e % 4 = 3 THEN 24000 ELSE (k + 1) * 1000 END AS num, CASE e % 4 WHEN 0 THEN k + 1 WHEN 1 THEN 1001 WHEN 2 THEN 1 ELSE 1001 END AS den FROM ({EVENTS_SQL})""")
def m18(spark, sf_dir):
    e, k = F.col("e"), F.col("k")
    text = F.when(e % 4 == 0, F.format_string("%d/%d", (k + 1) * 1000, k + 1)).when(e % 4 == 2, ((k + 1) * 1000).cast("string")).when(e % 4 == 3, F.lit("x/y"))
    return events(spark, sf_dir).select("clip_id", X.frame_rate(text).alias("r")).select("clip_id", "r.num", "r.den")


@query("f17_track_duration", f"SELECT clip_id, CASE WHEN e % 6 = 0 THEN CASE WHEN e + 0.5 > 86400 THEN (e + 0.5::DOUBLE) / 1000 ELSE e + 0.5::DOUBLE END WHEN e * 37 > 86400 THEN e * 37 / 1000.0::DOUBLE ELSE (e * 37)::DOUBLE END AS duration_s FROM ({EVENTS_SQL})")
def f17_track(spark, sf_dir):
    return M.track_duration(tracks(spark, sf_dir))


# HDR10+ documents -------------------------------------------------------------------------
def hdr10plus_text(spark, sf_dir):
    """Two scenes per event; the first-frame indices start at the event number."""
    k, e = F.col("k"), F.col("e")
    scene = '{"LuminanceParameters":{"MaxScl":[%d,%d,%d],"LuminanceDistributions":{"DistributionValues":[%d,%d,%d]}}}'
    first = F.format_string(scene, k * 100, k * 90, k * 110, k, k * 400, k * 50)
    second = F.format_string(scene, k * 10, k * 300, k * 20, k * 2, k * 30, e % 1000)
    return events(spark, sf_dir).select(
        "clip_id", "e", "k", F.format_string('{"SceneInfo":[%s,%s],"SceneInfoSummary":{"SceneFirstFrameIndex":[%d,%d]}}', first, second, e, e + 1).alias("text")
    )


def hdr10plus(spark, sf_dir):
    return hdr10plus_text(spark, sf_dir).select("clip_id", F.from_json("text", schemas.HDR10PLUS).alias("doc"))


@query("f18_hdr10plus_peak", f"""
    SELECT clip_id, i::INT AS scene, CASE i WHEN 0 THEN greatest(k * 400, k) / 10.0::DOUBLE ELSE greatest(k * 30, e % 1000) / 10.0::DOUBLE END AS histogram, CASE i WHEN 0 THEN k * 50 / 10.0::DOUBLE ELSE e % 1000 / 10.0::DOUBLE END AS h99,
           CASE i WHEN 0 THEN k * 110 / 10.0::DOUBLE ELSE k * 300 / 10.0::DOUBLE END AS scl,
           round(CASE i WHEN 0 THEN 0.2627::DOUBLE * k * 100 + 0.678::DOUBLE * k * 90 + 0.0593::DOUBLE * k * 110 ELSE 0.2627::DOUBLE * k * 10 + 0.678::DOUBLE * k * 300 + 0.0593::DOUBLE * k * 20 END / 10, 6) AS weighted
    FROM ({EVENTS_SQL}), (SELECT range AS i FROM range(2))""")
def f18(spark, sf_dir):
    rows = hdr10plus(spark, sf_dir).select("clip_id", F.posexplode("doc.SceneInfo").alias("scene", "s"))
    peaks = {"histogram": "histogram", "h99": "histogram99", "scl": "max-scl"}
    return rows.select(
        "clip_id", "scene", *[X.hdr10plus_peak_nits(F.col("s"), source).alias(name) for name, source in peaks.items()],
        six(X.hdr10plus_peak_nits(F.col("s"), "max-scl-luminance"), "weighted"),
    )


@query("a23_outlier_scenes", f"""
    SELECT clip_id, max(p) AS max_peak_nits, count(*) AS outlier_scene_count FROM (SELECT clip_id, k, unnest([greatest(k * 400, k) / 10.0::DOUBLE, greatest(k * 30, e % 1000) / 10.0::DOUBLE]) AS p FROM ({EVENTS_SQL}))
    WHERE p > 250 GROUP BY clip_id""")
def a23(spark, sf_dir):
    return M.outlier_scenes(hdr10plus(spark, sf_dir), "histogram", 250.0)


@query("s10_hdr10plus_reader", f"""
    SELECT 'v' || e AS clip_id, (e + i)::BIGINT AS first, [k * (CASE i WHEN 0 THEN 100 ELSE 10 END), k * (CASE i WHEN 0 THEN 90 ELSE 300 END), k * (CASE i WHEN 0 THEN 110 ELSE 20 END)]::BIGINT[] AS max_scl,
           CASE i WHEN 0 THEN [k, k * 400, k * 50] ELSE [k * 2, k * 30, e % 1000] END::BIGINT[] AS distribution FROM ({EVENTS_SQL}), (VALUES (0), (1)) v(i)""")
def s10(spark, sf_dir):
    """One document per event, many to a file, each line of which names its clip; read by the library and laid out by scene."""
    path = scratch(spark, "hdr10plus")
    hdr10plus_text(spark, sf_dir).select(F.concat(F.lit('{"clip_id":"'), "clip_id", F.lit('",'), F.expr("substring(text, 2)")).alias("text")).write.text(path)
    documents = readers.read_hdr10plus_lines(spark, path)
    scenes = documents.select("clip_id", "doc.SceneInfoSummary.SceneFirstFrameIndex", F.posexplode("doc.SceneInfo").alias("i", "s"))
    return scenes.select(
        "clip_id", F.get("SceneFirstFrameIndex", F.col("i")).alias("first"), F.col("s.LuminanceParameters.MaxScl").alias("max_scl"),
        F.col("s.LuminanceParameters.LuminanceDistributions.DistributionValues").alias("distribution"),
    )


# File formats -----------------------------------------------------------------------------
@query("s2_raw_planes", f"SELECT clip_id, frame_idx, x, y, y_code, cb_code, cr_code FROM ({A.MOSAIC_SQL})")
def s2(spark, sf_dir):
    """Planes of the mosaic as raw files of both layouts, four frames a file, read back two frames a task."""
    planes, back = mosaic_planes(spark, sf_dir), []
    for layout, clips in (("planar", ("m0", "m2")), ("p010", ("m1", "m3"))):
        path = scratch(spark, f"raw-{layout}")
        raw_video.write_raw(planes.where(F.col("clip_id").isin(*clips)), path, A.SIDE, A.SIDE, layout, frames_per_file=4, holes=True)
        back.append(raw_video.read_raw(spark, path, A.SIDE, A.SIDE, layout, frames_per_task=2, holes=True))
    return readers.samples_from_planes(back[0].union(back[1]))


@query("s4_reference_csv", f"SELECT clip_id, frame_idx, (our_code // 10)::INT AS min_pq, (our_code + 5)::INT AS max_pq, our_code AS avg_pq FROM ({audit.PAIRS_SQL})")
def s4(spark, sf_dir):
    code = F.col("our_code")
    rows = audit.ours(spark, sf_dir).select(
        "clip_id", (F.col("frame_idx") + 1).cast("bigint").alias("_line"),
        F.format_string("%d, %d,%d , %d,extra", F.col("frame_idx"), F.floor(code / 10), code + 5, code).alias("value"),
    )
    clips = rows.select("clip_id").distinct()
    header = clips.select("clip_id", F.lit(0).cast("bigint").alias("_line"), F.lit("frame,min_pq,max_pq,avg_pq").alias("value"))
    blank = rows.groupBy("clip_id").agg((F.max("_line") + 1).alias("_line")).withColumn("value", F.lit("   "))
    return readers.parse_reference_lines(rows.unionByName(header).unionByName(blank))


_L1_SQL = f"SELECT clip_id, frame_idx, {A.sql_pq12('min_pq')} AS min_pq_12bit, {A.sql_pq12('avg_pq')} AS avg_luma_pq_12bit, {A.sql_pq12('avg_max_rgb_pq')} AS avg_max_rgb_pq_12bit FROM ({W.SERIES_FRAMES_SQL})"


def _round_trip(spark, sf_dir):
    crops = A.series(spark, sf_dir).select("clip_id").distinct().select(
        "clip_id", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(40).alias("width"), F.lit(40).alias("height")).alias("rect")
    )
    path = scratch(spark, "sidecar")
    writers.write_sidecar(W.series_frames(spark, sf_dir), crops, path)
    return readers.read_sidecar(spark, path, require_scenes=True)


@query("s7_sidecar_frames", _L1_SQL)
def s7(spark, sf_dir):
    return _round_trip(spark, sf_dir)[0]


@query("s6_sidecar_scenes", W.SCENE_L1_SQL)
def s6(spark, sf_dir):
    return _round_trip(spark, sf_dir)[1]


STATS = "frame INT, selected_pq DOUBLE, raw_max_pq DOUBLE, percentile_pq DOUBLE, robust_pq DOUBLE, sigma_pq DOUBLE, correction_pq DOUBLE, n_eff BIGINT"


@query("s8_frame_statistics", f"""
    SELECT clip_id, frame_idx AS frame, round(robust_pq, 6) AS selected_pq, round(raw_max_pq, 6) AS raw_max_pq, round(percentile_pq, 6) AS percentile_pq, round(robust_pq, 6) AS robust_pq,
           round(sigma_pq, 8) AS sigma_pq, round(raw_max_pq - robust_pq, 6) AS correction_pq, n_eff FROM ({robust_sql(MOSAIC_FINE_SQL, MOSAIC_TAILS)})""")
def s8(spark, sf_dir):
    fine, diffs, raw = mosaic_parts(spark, sf_dir)
    path = scratch(spark, "stats")
    writers.write_peak_stats(measure.peak_stats(fine, raw, diffs, "robust"), path)
    back = ordered_text.read_csv(spark, path, STATS)
    return back.withColumns({c: F.round(c, 8 if c == "sigma_pq" else 6) for c in writers.STATS_COLUMNS}).select("clip_id", "frame", *writers.STATS_COLUMNS, "n_eff")


DELTAS = "frame INT, ref_min_pq INT, our_min_pq INT, ref_max_pq INT, our_max_pq STRING, ref_avg_pq INT, our_avg_luma_pq INT, our_avg_max_rgb_pq INT"
SHORT_DELTAS = "frame INT, ref_max_pq INT, our_max_pq STRING, ref_avg_pq INT, our_avg_pq STRING"


@query("s9_frame_deltas", f"""
    SELECT clip_id, frame_idx AS frame, ref_code - 3 AS ref_min_pq, our_code - 2 AS our_min_pq, ref_code AS ref_max_pq, printf('%.1f', our_code + 0.25::DOUBLE) AS our_max_pq,
           ref_code + 1 AS ref_avg_pq, our_code + 2 AS our_avg_luma_pq, our_code + 3 AS our_avg_max_rgb_pq, printf('%.1f', our_code + 0.75::DOUBLE) AS short_avg_pq FROM ({audit.PAIRS_SQL})""")
def s9(spark, sf_dir):
    """Both layouts, written and read back; the short one has an average of its own."""
    code, ref = F.col("our_code"), F.col("ref_code")
    joined = scoring.align(audit.ours(spark, sf_dir), audit.reference(spark, sf_dir), "inner").select(
        *FRAME, (ref - 3).alias("ref_min_pq"), (code - 2).alias("our_min_pq"), ref.alias("ref_max_pq"), ((code + 0.25) / 4095.0).alias("peak_pq"), ((code + 0.75) / 4095.0).alias("avg_pq"),
        (ref + 1).alias("ref_avg_pq"), (code + 2).alias("our_avg_luma_pq"), (code + 3).alias("our_avg_max_rgb_pq"),
    )
    whole, short = scratch(spark, "deltas"), scratch(spark, "short-deltas")
    writers.write_deltas(joined, whole, True)
    writers.write_deltas(joined, short, False)
    other = ordered_text.read_csv(spark, short, SHORT_DELTAS).withColumnRenamed("our_avg_pq", "short_avg_pq")
    return ordered_text.read_csv(spark, whole, DELTAS).join(other, ["clip_id", "frame", "ref_max_pq", "our_max_pq", "ref_avg_pq"])


_LUM = f"SELECT clip_id, frame_idx, bin, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {KEY}) AS pct FROM ({LUM_SQL})"
_HUE = f"SELECT clip_id, frame_idx, bin, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {KEY}) AS pct FROM (SELECT {KEY}, {A.sql_hue_bin()} AS bin, count(*) AS n FROM ({A.SAMPLES_SQL}) GROUP BY ALL) WHERE bin IS NOT NULL"
_LEVELS = f"SELECT {KEY}, (frame_idx // 30)::INT AS scene_id, max({A.sql_max_rgb()}) AS peak_pq, avg({A.sql_luma()}) AS avg_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL"


@query("s12_measurement_tables", f"""
    SELECT clip_id, 'lum' AS part, frame_idx AS item, bin::INT AS bin, round(pct, 6) AS value FROM ({_LUM})
    UNION ALL SELECT clip_id, 'hue', frame_idx, bin::INT, round(pct, 6) FROM ({_HUE})
    UNION ALL SELECT clip_id, 'peak', frame_idx, scene_id, round(peak_pq, 6) FROM ({_LEVELS})
    UNION ALL SELECT clip_id, 'target', frame_idx, scene_id, round({A.sql_pq_to_nits('peak_pq')}) FROM ({_LEVELS}) WHERE frame_idx % 9 != 0
    UNION ALL SELECT clip_id, 'start', scene_id, 0, min(frame_idx) FROM ({_LEVELS}) GROUP BY clip_id, scene_id
    UNION ALL SELECT clip_id, 'end', scene_id, 0, max(frame_idx) FROM ({_LEVELS}) GROUP BY clip_id, scene_id
    UNION ALL SELECT clip_id, 'scene_avg', scene_id, 0, round(avg(avg_pq), 6) FROM ({_LEVELS}) GROUP BY clip_id, scene_id
    UNION ALL SELECT clip_id, 'maxcll', 0, 0, max(round({A.sql_pq_to_nits('peak_pq')})) FROM ({_LEVELS}) GROUP BY clip_id
    UNION ALL SELECT clip_id, 'frame_count', 0, 0, count(*) FROM ({_LEVELS}) GROUP BY clip_id
    UNION ALL SELECT clip_id, 'scene_count', 0, 0, count(DISTINCT scene_id) FROM ({_LEVELS}) GROUP BY clip_id""")
def s12(spark, sf_dir):
    """Headers, scenes and frames with both histograms, written, read back and laid out value by value."""
    frames = measure.measure_frames(A.samples(spark, sf_dir)).withColumn("scene_id", F.expr("frame_idx div 30").cast("int"))
    target = F.when(F.col("frame_idx") % 9 != 0, F.round(T.pq_to_nits("peak_pq")).cast("int"))
    stored = staged(frames.select(*FRAME, "peak_pq", "avg_pq", "min_pq", "avg_max_rgb_pq", "lum_hist", "hue_hist", target.alias("target_nits"), "scene_id"), "s12-frames")
    scenes = rollups.scene_stats(stored)
    path = scratch(spark, "measurements")
    writers.write_measurements(rollups.headers(stored, scenes), scenes, stored, path)
    headers, scenes, back = readers.read_measurements(spark, path)

    def bins(name, column):
        return back.select("clip_id", F.lit(name).alias("part"), F.col("frame_idx").alias("item"), F.posexplode(column).alias("bin", "value")).where("value > 0").withColumn("value", F.round("value", 6))

    def values(rows, name, item, bin, value):
        return rows.select("clip_id", F.lit(name).alias("part"), item.cast("int").alias("item"), bin.cast("int").alias("bin"), value.cast("double").alias("value"))

    none, scene, frame = F.lit(0), F.col("scene_id"), F.col("frame_idx")
    parts = [
        bins("lum", "lum_hist"), bins("hue", "hue_hist"), values(back, "peak", frame, scene, F.round("peak_pq", 6)), values(back.where("target_nits IS NOT NULL"), "target", frame, scene, F.col("target_nits")),
        values(scenes, "start", scene, none, F.col("start")), values(scenes, "end", scene, none, F.col("end")), values(scenes, "scene_avg", scene, none, F.round("avg_pq", 6)),
        *[values(headers, c, none, none, F.col(c)) for c in ("maxcll", "frame_count", "scene_count")],
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s13_shot_configuration", f"""
    SELECT clip_id, '8.1' AS profile, trunc(max_dml)::INT AS dml, 'V40' AS cm, round({A.sql_nits_to_pq('600.0::DOUBLE')} * 4095)::INT AS second_trim, CASE WHEN e % 4 = 0 THEN 0 WHEN e % 4 = 1 THEN 2 WHEN e % 2 = 0 THEN 1 ELSE 2 END AS primaries, 5 AS blocks FROM ({DEFAULTED_SQL})""")
def s13(spark, sf_dir):
    configs = writers.config_documents(defaulted(spark, sf_dir), primaries=M.source_primaries(tracks(spark, sf_dir)))
    path = scratch(spark, "configs")
    writers.write_configs(configs, path)
    get = lambda p, kind="int": F.get_json_object("config", p).cast(kind)
    return readers.read_configs(spark, path).select(
        "clip_id", get("$.profile", "string").alias("profile"), get("$.level6.max_display_mastering_luminance").alias("dml"), get("$.cm_version", "string").alias("cm"),
        get("$.default_metadata_blocks[1].Level2.target_max_pq").alias("second_trim"), get("$.default_metadata_blocks[3].Level9.source_primary_index").alias("primaries"),
        F.json_array_length(F.get_json_object("config", "$.default_metadata_blocks")).alias("blocks"),
    )


@query("s13_configured_shots", f"""SELECT clip_id, (max("end") + 1)::INT AS length, count(*)::INT AS shots, 'V29' AS version FROM ({W.SCENE_L1_SQL}) GROUP BY clip_id""")
def s13_shots(spark, sf_dir):
    scene_l1 = rollups.scene_l1(W.series_frames(spark, sf_dir))
    static = scene_l1.select("clip_id").distinct().select("clip_id", *[F.lit(v).alias(k) for k, v in X.STATIC_DEFAULTS.items()])
    configs = writers.config_documents(static, cm_version=None, scene_l1_rows=scene_l1)
    return configs.select(
        "clip_id", F.get_json_object("config", "$.length").cast("int").alias("length"), F.json_array_length(F.get_json_object("config", "$.shots")).alias("shots"),
        F.get_json_object("config", "$.l1_avg_pq_cm_version").alias("version"),
    )


# Catalogue --------------------------------------------------------------------------------
PATHS_SQL = """SELECT p_partkey AS p, 'lib/' || (['Show', 'show', 'Film 10', 'Film 9'])[p_partkey % 4 + 1] || CASE WHEN p_partkey % 4 < 2 THEN ' S' || (p_size % 4 + 1) || 'E' || (p_partkey % 200) ELSE ' ' || (p_partkey % 300) END
    || CASE WHEN p_partkey % 7 = 0 THEN '.DV.mkv' WHEN p_partkey % 11 = 0 THEN '.txt' WHEN p_partkey % 13 = 0 THEN '_temp_1/a.mkv' ELSE '.mkv' END AS path FROM part"""


def paths(spark, sf_dir):
    p = F.col("p_partkey")
    name = F.element_at(F.array(F.lit("Show"), F.lit("show"), F.lit("Film 10"), F.lit("Film 9")), (p % 4 + 1).cast("int"))
    middle = F.when(p % 4 < 2, F.format_string(" S%dE%d", F.col("p_size") % 4 + 1, p % 200)).otherwise(F.concat(F.lit(" "), p % 300))
    ending = F.when(p % 7 == 0, ".DV.mkv").when(p % 11 == 0, ".txt").when(p % 13 == 0, "_temp_1/a.mkv").otherwise(".mkv")
    return A.table(spark, sf_dir, "part").select(p.alias("p"), F.concat(F.lit("lib/"), name, middle, ending).alias("path"))


@query("p8_skip_converted", f"SELECT p, path FROM ({PATHS_SQL}) WHERE NOT ends_with(path, '.DV.mkv')")
def p8(spark, sf_dir):
    return S.skip_converted(paths(spark, sf_dir))


@query("p8_skipped_count", f"SELECT count(CASE WHEN ends_with(path, '.DV.mkv') THEN 1 END) AS skipped, count(CASE WHEN NOT ends_with(path, '.DV.mkv') THEN 1 END) AS kept FROM ({PATHS_SQL})")
def p8_count(spark, sf_dir):
    return S.skipped_count(paths(spark, sf_dir))


@query("s15_list_catalog", f"""
    SELECT path, coalesce(try_cast(nullif(regexp_extract(lower(path), 's(\\d{{1,2}})e(\\d{{1,3}})', 1), '') AS BIGINT), 4294967295) AS season, coalesce(try_cast(nullif(regexp_extract(lower(path), 's(\\d{{1,2}})e(\\d{{1,3}})', 2), '') AS BIGINT), 4294967295) AS episode
    FROM ({PATHS_SQL}) WHERE ends_with(lower(path), '.mkv') AND NOT contains(path, '_temp_')""")
def s15(spark, sf_dir):
    return catalog.list_catalog(paths(spark, sf_dir)).select("path", "season", "episode")


_PIECE = "regexp_replace(piece, '^0+(.)', '\\1')"
_PIECE_KEY = f"CASE WHEN regexp_matches(piece, '^[0-9]') THEN '0' || lpad(length({_PIECE})::VARCHAR, 4, '0') || {_PIECE} || lpad(length(piece)::VARCHAR, 4, '0') ELSE piece END"


@query("o3_natural_order", f"""
    SELECT path, array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda piece: {_PIECE_KEY}), '') AS natural_key
    FROM ({PATHS_SQL}) WHERE ends_with(path, '.mkv') AND NOT ends_with(path, '.DV.mkv') AND NOT contains(path, '_temp_')""")
def o3(spark, sf_dir):
    listed = catalog.list_catalog(S.skip_converted(paths(spark, sf_dir)))
    return catalog.natural_order(listed).select("path", "natural_key")


FILES_SQL = "SELECT p_partkey AS p, 'd' || (p_partkey % 50) || '/' AS dir, 'Film ' || p_partkey AS stem FROM part"
EXISTING_SQL = f"""SELECT dir || stem || '.measurements' AS path FROM ({FILES_SQL}) WHERE p % 3 = 0 UNION ALL SELECT dir || stem || '_measurements.bin' FROM ({FILES_SQL}) WHERE p % 2 = 0
    UNION ALL SELECT dir || stem || '.mkv.measurements' FROM ({FILES_SQL}) WHERE p % 5 = 0 UNION ALL SELECT DISTINCT dir || 'measurements.bin' FROM ({FILES_SQL}) WHERE p % 50 = 7"""


@query("s14_side_files", f"""
    SELECT 'v' || p AS clip_id, CASE WHEN p % 50 = 7 THEN dir || 'measurements.bin' WHEN p % 5 = 0 THEN dir || stem || '.mkv.measurements' WHEN p % 3 = 0 THEN dir || stem || '.measurements' ELSE dir || stem || '_measurements.bin' END AS path
    FROM ({FILES_SQL}) WHERE p % 50 = 7 OR p % 5 = 0 OR p % 3 = 0 OR p % 2 = 0""")
def s14(spark, sf_dir):
    p = F.col("p_partkey")
    base = A.table(spark, sf_dir, "part").select(p.alias("p"), F.concat(F.lit("d"), p % 50, F.lit("/")).alias("dir"), F.concat(F.lit("Film "), p).alias("stem"))
    clips = base.select(F.concat(F.lit("v"), "p").alias("clip_id"), F.concat("dir", "stem", F.lit(".mkv")).alias("path"))
    file = lambda ending, there: base.where(there).select(F.concat("dir", "stem", F.lit(ending)).alias("path"))
    files = file(".measurements", F.col("p") % 3 == 0).unionByName(file("_measurements.bin", F.col("p") % 2 == 0)).unionByName(
        file(".mkv.measurements", F.col("p") % 5 == 0)
    ).unionByName(base.where(F.col("p") % 50 == 7).select(F.concat("dir", F.lit("measurements.bin")).alias("path")).distinct())
    return catalog.find_side_files(clips, files)
