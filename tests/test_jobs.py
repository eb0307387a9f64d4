"""Scenes, smoothing, targets, metadata and whole jobs on literal cases and the small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lumaspark import schemas
from lumaspark.operators import checks as K, metadata as M, rollups, scenes as SC, scoring, smoothing, targets
from lumaspark.plans.analyze import Options, analyze, with_quality
from lumaspark.sources import catalog, readers, writers
from lumaspark.functions import transfer as T
from lumaspark.workbench import adapters as A


def test_cuts_need_a_full_scene_and_become_scenes(spark):
    rows = [("a", i, 1.0 if i in (10, 24, 30, 60) else 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, smoothed DOUBLE")
    cuts = SC.accept_cuts(df, 0.3, 24)
    assert sorted(r.frame_idx for r in cuts.collect()) == [24, 60]
    counts = spark.createDataFrame([("a", 100), ("none", 7)], "clip_id STRING, frame_count INT")
    scenes = sorted(tuple(r) for r in SC.scenes_from_cuts(cuts, counts).select("clip_id", "scene_id", "start", "end").collect())
    assert scenes == [("a", 0, 0, 23), ("a", 1, 24, 59), ("a", 2, 60, 99), ("none", 0, 0, 6)]


def test_average_smoothing(spark):
    rows = [("a", 0, i, i, v, v) for i, v in enumerate((0.1, 0.4, 0.2, 0.8))]
    df = spark.createDataFrame(rows, "clip_id STRING, scene_id INT, frame_idx INT, scene_pos INT, luma DOUBLE, rgb DOUBLE")
    got = smoothing.smooth_average(df, ["luma", "rgb"], 0.1, 3).orderBy("frame_idx").collect()
    assert [r.luma for r in got] == [r.rgb for r in got]
    assert [r.luma for r in got] == pytest.approx([0.1, 0.13, 0.13, 0.137])


def test_long_histogram_average_crosses_chunks(spark):
    rows = [("a", 0, i, i, [float((i * 7 + b) % 11) for b in range(256)]) for i in range(40)]
    df = spark.createDataFrame(rows, "clip_id STRING, scene_id INT, frame_idx INT, scene_pos INT, lum_hist ARRAY<DOUBLE>")
    got = {r.frame_idx: r.lum_hist for r in smoothing.ema_histogram(df, 0.1, 8).collect()}
    state = [0.0] * 256
    for *_x, i, hist in rows:
        state = [0.1 * h + 0.9 * s for h, s in zip(hist, state)]
        total = sum(state)
        assert got[i] == pytest.approx([s * 100 / total for s in state])


def test_targets_smooth_within_scenes(spark):
    rows = [("a", i // 6, i, i % 6, 1000 if i % 2 else 500) for i in range(12)] + [("b", 0, i, i, None if i == 2 else 700) for i in range(4)]
    df = spark.createDataFrame(rows, "clip_id STRING, scene_id INT, frame_idx INT, scene_pos INT, target_nits INT")
    got = {(r.clip_id, r.frame_idx): r.target_nits for r in targets.smooth_targets(df).collect()}
    assert all(500 < got["a", i] < 1000 for i in range(1, 5)) and [got["a", i] for i in range(6)] == [got["a", i + 6] for i in range(6)]
    assert [got["b", i] for i in range(4)] == [700, 700, None, 700]
    off = targets.smooth_targets(df, alpha=0.0)
    assert off is df


def test_heuristic_branches(spark):
    rows = [("dark", 600.0, 10.0, 10.0, 5000.0), ("mid", 5000.0 * 0 + 900.0, 100.0, 100.0, 500.0), ("bright", 3000.0, 400.0, 400.0, 9000.0), ("extreme", 6000.0, 10.0, 10.0, 3000.0)]
    df = spark.createDataFrame(rows, "clip_id STRING, nits DOUBLE, apl_nits DOUBLE, scene_apl_nits DOUBLE, knee_nits DOUBLE").withColumn("peak_pq", T.nits_to_pq(F.col("nits") + 0.5))
    got = {r.clip_id: r.raw_target for r in targets.raw_target(df).collect()}
    assert got == {"dark": 800, "mid": 550, "bright": 1000, "extreme": 3000}
    with pytest.raises(ValueError):
        targets.profile_named("loud")


def test_header_and_falls(spark):
    rows = [("a", i, 0, n, n * 2) for i, n in enumerate((100.0, 200.0, 300.0))]
    df = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, scene_id INT, avg DOUBLE, peak DOUBLE")
    frames = df.select("clip_id", "frame_idx", "scene_id", T.nits_to_pq("avg").alias("avg_pq"), T.nits_to_pq("peak").alias("peak_pq"), F.lit(None).cast("int").alias("target_nits"))
    header = rollups.headers(frames, rollups.scene_stats(frames), 6, False, 900).first()
    assert (header.maxfall, header.avgfall, header.maxcll, header.flags, header.target_peak_nits) == (300, 200, 600, 2, 900)
    many = spark.createDataFrame([("a", i, float(i + 1)) for i in range(1000)], "clip_id STRING, frame_idx INT, nits DOUBLE").withColumn("peak_pq", T.nits_to_pq("nits"))
    assert rollups.max_cll(many, "histogram99").first().maxcll == 990 and rollups.max_cll(many, "histogram999").first().maxcll == 999


def test_health_reports(spark):
    clipped = [(0, 1200, 3079), (0, 1300, 3078), (0, 900, 2500)]
    static = [(i, 1200 + i, 2500) for i in range(3)]
    healthy = [(0, 900, 2200), (0, 1300, 2800), (0, 1500, 3300)]
    rare = [(0, 1000, 2500)] * 807 + [(0, 1200, 3079)] * 12
    rows = [(name, i, *row) for name, series in (("clipped", clipped), ("static", static), ("healthy", healthy), ("rare", rare)) for i, row in enumerate(series)]
    df = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, min_pq INT, avg_pq INT, max_pq INT")
    mastering = spark.createDataFrame([("clipped", 3079), ("healthy", 3696), ("rare", 3079), ("static", None)], "clip_id STRING, mastering_peak_pq INT")
    got = {r.clip_id: r for r in M.health_report(df, mastering).collect()}
    assert got["clipped"].suspicious and got["clipped"].clipped_scene_count == 2
    assert got["static"].reasons == ["static L1 max"] and not got["healthy"].suspicious
    assert got["rare"].clipped_frame_ratio > 0.01 and got["rare"].scene_count == 2


def test_generated_metadata_rules(spark):
    def doc(l1=(0, 1310, 2081), v40=True):
        blocks = [{"Level1": dict(zip(("min_pq", "avg_pq", "max_pq"), l1))}, {"Level6": {"max_display_mastering_luminance": 1000, "min_display_mastering_luminance": 1, "max_content_light_level": 997, "max_frame_average_light_level": 200}}]
        newer = [{"Level9": {"source_primary_index": 0}}, {"Level11": {"content_type": 1}}, {"Level254": {"dm_mode": 0, "dm_version_index": 2}}] if v40 else []
        return json.dumps({"dovi_profile": 8, "vdr_dm_data": {"cmv29_metadata": {"ext_metadata_blocks": blocks}, "cmv40_metadata": {"ext_metadata_blocks": newer}}})

    rows = [("good", doc()), ("order", doc((0, 3000, 2081))), ("old", doc(v40=False))]
    df = spark.createDataFrame(rows, "clip_id STRING, t STRING").withColumn("doc", F.from_json("t", schemas.EXPORTED))
    got = {}
    for r in K.check_metadata(df).collect():
        got.setdefault(r.clip_id, set()).add(r.rule)
    assert got == {"order": {"l1_order"}, "old": {"l9_missing", "l11_missing", "l254_version"}}


def test_configuration_documents(spark):
    static = spark.createDataFrame([("a", 1000.0, 0.0001, 211.0, 125.0)], "clip_id STRING, max_dml DOUBLE, min_dml DOUBLE, max_cll DOUBLE, max_fall DOUBLE")
    l5 = spark.createDataFrame([("a", 0, 0, 132, 132)], "clip_id STRING, left INT, right INT, top INT, bottom INT")
    scenes = spark.createDataFrame([("a", 0, 0, 213, 0, 592, 614, 2437), ("a", 1, 214, 333, 1, 441, 462, 3416)],
                                   "clip_id STRING, scene_id INT, start INT, end INT, min_pq_12bit INT, avg_luma_pq_12bit INT, avg_max_rgb_pq_12bit INT, max_pq_12bit INT")
    primaries = spark.createDataFrame([("a", 0)], "clip_id STRING, primary_index INT")
    config = json.loads(writers.config_documents(static, primaries=primaries, level5=l5, scene_l1_rows=scenes).first().config)
    blocks = config["default_metadata_blocks"]
    assert [b["Level2"]["target_max_pq"] for b in blocks[:3]] == [2081, 2851, 3079]
    assert blocks[3]["Level9"]["source_primary_index"] == 0 and blocks[4]["Level11"]["reference_mode_flag"] is False
    assert config["length"] == 334 and [s["start"] for s in config["shots"]] == [0, 214] and config["shots"][1]["metadata_blocks"][0]["Level1"]["avg_pq"] == 462
    assert config["level5"]["active_area_top_offset"] == 132 and config["level6"]["min_display_mastering_luminance"] == 1
    with pytest.raises(Exception, match="missing static metadata"):
        writers.config_documents(static.withColumn("min_dml", F.lit(None).cast("double"))).collect()


def test_reference_and_shot_files(spark, tmp_path):
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "film.csv").write_text("frame,min_pq,max_pq,avg_pq\n0, 1,2,3\n\n1,4,5,6,7\n")
    assert sorted(tuple(r) for r in readers.read_reference_l1(spark, str(tmp_path / "ref")).collect()) == [("film", 0, 1, 2, 3), ("film", 1, 4, 5, 6)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "film.csv").write_text("0,1,2,3\nframe,1,2,3\n")
    with pytest.raises(Exception, match="without a valid frame_idx"):
        readers.read_reference_l1(spark, str(tmp_path / "bad")).collect()
    counts = spark.createDataFrame([("film", 40)], "clip_id STRING, frame_count INT")
    for name, text, want in (("good", "0\n10\n\n25\n40\n", [(0, 10), (10, 25), (25, 40)]), ("late", "5\n10\n", None), ("back", "0\n20\n10\n", None), ("far", "0\n50\n", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "film.txt").write_text(text)
        shots = readers.read_shots(spark, str(tmp_path / name), counts)
        if want is None:
            with pytest.raises(Exception, match="broken shot list"):
                shots.collect()
        else:
            assert sorted((r.start, r.end_excl) for r in shots.collect()) == want


def test_shot_means(spark):
    series = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((1, 5, 3, 8, 2, 4))], "clip_id STRING, frame_idx INT, value DOUBLE")
    shots = spark.createDataFrame([("a", 0, 0, 3), ("a", 1, 3, 6)], "clip_id STRING, shot_id INT, start INT, end_excl INT")
    values = {m: [r.value for r in scoring.shot_aggregate(series, shots, m).orderBy("shot_id").collect()] for m in ("max", "min", "mean")}
    assert values == {"max": [5.0, 8.0], "min": [1.0, 2.0], "mean": [3.0, pytest.approx(14 / 3)]}


def test_listing(spark, tmp_path):
    for name in ("Show S1E10.mkv", "Show S1E9.mkv", "note.txt", "b10.mkv", "b9.mkv"):
        (tmp_path / name).write_text("x")
    listed = catalog.natural_order(catalog.list_catalog(catalog.read_listing(spark, str(tmp_path)), r"no_such_folder"))
    assert [r.path.rsplit("/", 1)[1].replace("%20", " ") for r in listed.collect()] == ["Show S1E9.mkv", "Show S1E10.mkv", "b9.mkv", "b10.mkv"]


def test_analysis_keeps_the_invariants(spark, small):
    result = analyze(A.samples(spark, small), None, Options(scene_threshold=60.0, version=6))
    frames, scenes, headers = (t.cache() for t in (result.frames, result.scenes, result.headers))
    found = K.all_violations(
        K.check_scene_ranges(scenes, frames), K.check_scene_coverage(scenes, frames), K.check_lum_hist(frames), K.check_hue_hist(frames),
        K.check_pq_range(frames), K.check_fall(headers, frames), K.check_flags(headers, frames),
    )
    # At this scale a clip may lack a frame altogether; its scenes then end beyond the frame count.
    whole = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.max("frame_idx").alias("last")).where("n = last + 1")
    assert whole.count() >= 6 and found.join(whole, "clip_id", "left_semi").count() == 0
    assert headers.where("target_peak_nits != maxcll or flags != 3").count() == 0
    assert frames.where("target_nits is null").count() == 0


def test_options_are_checked():
    for bad in ({"min_percentile": 101.0}, {"hlg_peak_nits": 0.0}, {"denoise": "nlmeans"}, {"profile": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)
    fast = with_quality("fast", Options())
    assert (fast.stride, fast.sample_rate) == (2, 3)
