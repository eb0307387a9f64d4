"""Explicit schemas of every table the library reads or writes (never inferred)."""

from __future__ import annotations

SAMPLES = (
    "clip_id STRING, frame_idx INT, x INT, y INT, y_code INT, cb_code INT, cr_code INT"
)
# Planes are packed 16-bit little-endian words: a binary value moves to a task as one block,
# an array would be converted element by element.
PLANES = (
    "clip_id STRING, frame_idx INT, width INT, height INT, "
    "luma BINARY, cb BINARY, cr BINARY"
)
CLIPS = "clip_id STRING, width INT, height INT, transfer STRING, hlg_peak_nits DOUBLE, name STRING"
RECT = "STRUCT<x: INT, y: INT, width: INT, height: INT>"
FRAMES = (
    "clip_id STRING, frame_idx INT, peak_pq DOUBLE, avg_pq DOUBLE, min_pq DOUBLE, "
    "avg_max_rgb_pq DOUBLE, lum_hist ARRAY<DOUBLE>, hue_hist ARRAY<DOUBLE>, "
    "target_nits INT, scene_id INT"
)
SCENES = "clip_id STRING, scene_id INT, start INT, end INT, peak_nits INT, avg_pq DOUBLE"
HEADERS = (
    "clip_id STRING, version INT, scene_count INT, frame_count INT, flags INT, "
    "maxcll INT, maxfall INT, avgfall INT, target_peak_nits INT"
)
REFERENCE_L1 = "frame_idx INT, min_pq INT, max_pq INT, avg_pq INT"
SIDECAR = (
    "clip_id STRING, version INT, min_percentile DOUBLE, denoise_mode STRING, peak_domain STRING, "
    "peak_estimator STRING, peak_percentile DOUBLE, "
    "crop STRUCT<x: INT, y: INT, width: INT, height: INT>, "
    "scenes ARRAY<STRUCT<start: INT, end: INT, min_pq_12bit: INT, avg_luma_pq_12bit: INT, "
    "avg_max_rgb_pq_12bit: INT, max_pq_12bit: INT>>, "
    "frames STRUCT<min_pq_12bit: ARRAY<INT>, avg_luma_pq_12bit: ARRAY<INT>, "
    "avg_max_rgb_pq_12bit: ARRAY<INT>>"
)
HDR10PLUS = (
    "SceneInfo ARRAY<STRUCT<LuminanceParameters: STRUCT<MaxScl: ARRAY<BIGINT>, "
    "LuminanceDistributions: STRUCT<DistributionValues: ARRAY<BIGINT>>>>>, "
    "SceneInfoSummary STRUCT<SceneFirstFrameIndex: ARRAY<BIGINT>>"
)
TRACKS = "media STRUCT<track: ARRAY<MAP<STRING, STRING>>>"
_BLOCK = (
    "ARRAY<STRUCT<Level1: STRUCT<min_pq: BIGINT, avg_pq: BIGINT, max_pq: BIGINT>, "
    "Level5: STRUCT<active_area_left_offset: BIGINT, active_area_right_offset: BIGINT, "
    "active_area_top_offset: BIGINT, active_area_bottom_offset: BIGINT>, "
    "Level6: STRUCT<max_display_mastering_luminance: BIGINT, min_display_mastering_luminance: BIGINT, "
    "max_content_light_level: BIGINT, max_frame_average_light_level: BIGINT>, "
    "Level9: STRUCT<source_primary_index: BIGINT>, "
    "Level11: STRUCT<content_type: BIGINT, reference_mode_flag: BOOLEAN>, "
    "Level254: STRUCT<dm_mode: BIGINT, dm_version_index: BIGINT>>>"
)
EXPORTED = (
    "dovi_profile BIGINT, el_type STRING, vdr_dm_data STRUCT<"
    f"cmv29_metadata: STRUCT<ext_metadata_blocks: {_BLOCK}>, "
    f"cmv40_metadata: STRUCT<ext_metadata_blocks: {_BLOCK}>>"
)
CURVE = (
    "STRUCT<kind: STRING, pivots: ARRAY<BIGINT>, "
    "pieces: ARRAY<STRUCT<ord: INT, constant: BIGINT, coefs: ARRAY<ARRAY<BIGINT>>>>>"
)
VIOLATIONS = "clip_id STRING, item INT, rule STRING, severity STRING, detail STRING"
