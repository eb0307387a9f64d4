"""What is missing must not lose anything: clips without a crop, absent frames, short layers, truncated files."""

import random
import tempfile
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspark.operators import composite as C, grain, measure, ordered as O, planes as P, samples as S, scenes as SC, smoothing
from lumaspark.plans.analyze import Options, analyze
from lumaspark.session import stage_dir
from lumaspark.sources import raw_video, readers
from lumaspark.streaming import live as L
from lumaspark.workbench import layers

FRAME = ["clip_id", "frame_idx"]


def raw_planes(spark, width, height, frames=2, extra=b"", layout="planar"):
    rng = np.random.default_rng(3)
    site = ((width + 1) // 2) * ((height + 1) // 2)
    words = rng.integers(64, 941, frames * (width * height + 2 * site)).astype("<u2")
    folder = tempfile.mkdtemp(prefix="spark-raw-")
    for name, content in (("a", words.tobytes() + extra), ("b", words.tobytes())):
        with open(f"{folder}/{name}.yuv", "wb") as out:
            out.write(content)
    return raw_video.read_raw(spark, folder, width, height, layout)


@pytest.mark.parametrize("size", [(5, 5), (8, 6), (7, 4)])
@pytest.mark.parametrize("layout", ["planar", "p010"])
def test_odd_sizes(spark, size, layout):
    samples = readers.samples_from_planes(raw_planes(spark, *size, layout=layout))
    assert samples.count() == 2 * 2 * size[0] * size[1]


def test_trailing_bytes_fail(spark):
    with pytest.raises(Exception, match="no whole 8x6 frame"):
        raw_planes(spark, 8, 6, extra=b"\0" * 14).count()


def crops(spark, *clips):
    return spark.createDataFrame([(c,) for c in clips], "clip_id STRING").select("clip_id", F.expr("named_struct('x', 2, 'y', 2, 'width', 4, 'height', 2)").alias("rect"))


def test_clip_without_crop_is_measured_whole(spark):
    planes = raw_planes(spark, 8, 6)
    samples = readers.samples_from_planes(planes)
    some, none = crops(spark, "a"), crops(spark)
    long_form = measure.measure_frames(S.crop_samples(samples, some), crops=some)
    stored = P.measure_planes(planes, crops=some)
    whole = {tuple(r[c] for c in FRAME): r for r in measure.measure_frames(samples).collect()}
    for got in (long_form, stored):
        rows = {tuple(r[c] for c in FRAME): r for r in got.collect()}
        assert set(rows) == set(whole)
        for key in (("b", 0), ("b", 1)):
            assert rows[key].peak_pq == pytest.approx(whole[key].peak_pq) and rows[key].lum_hist == pytest.approx(whole[key].lum_hist)
            assert rows[key].hue_hist == pytest.approx(whole[key].hue_hist)
    assert grain.median3(samples, none).count() == samples.count()
    assert S.stride_samples(samples, none, 2).count() == 2 * 2 * 4 * 3
    assert {r.clip_id for r in grain.cross_quad_diffs(samples, some).select("clip_id").distinct().collect()} == {"a", "b"}


def test_absent_sampled_frames(spark):
    every = spark.createDataFrame([("a", i) for i in range(12)], "clip_id STRING, frame_idx INT")
    analysed = spark.createDataFrame([("a", i, i * 10) for i in (3, 6, 9) if i != 6], "clip_id STRING, frame_idx INT, v INT")
    got = {r.frame_idx: r.v for r in SC.hold_analysed(every, analysed, 3).collect()}
    assert got == {i: 30 if i < 9 else 90 for i in range(12)}


def gappy(spark):
    rng = random.Random(8)
    rows = [("a", i, i // 400, rng.random(), [rng.random() for _ in range(4)] + [0.0] * 252) for i in range(1100) if i not in (300, 511, 512, 513, 1023) and not 600 <= i < 640]
    return rows, spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, scene_id INT, x DOUBLE, lum_hist ARRAY<DOUBLE>")


def by_frame(df, column):
    return {r.frame_idx: r[column] for r in df.select("frame_idx", column).collect()}


def test_gaps_and_chunk_sizes(spark):
    rows, table = gappy(spark)
    for chunk in (4, 512):
        smooth = by_frame(SC.smooth_distance(table.withColumnRenamed("x", "distance"), 5, 1, chunk), "smoothed")
        for k, row in enumerate(rows):
            near = [r[3] for r in rows[max(0, k - 4):k + 1]]
            assert smooth[row[1]] == pytest.approx(sum(near) / len(near))
        apart = by_frame(SC.histogram_distance(table, 1, chunk), "distance")
        assert [f for f, d in apart.items() if d is None] == [0]
    placed = smoothing.scene_position(table)
    means = by_frame(smoothing.smooth_average(placed, ["x"], 0.001, 0), "x")
    bins = by_frame(smoothing.ema_histogram(placed, 0.001, 64), "lum_hist")
    state, total, scene = 0.0, np.zeros(256), None
    for _, frame, s, x, h in rows:
        if s != scene:
            state, total, scene = x, np.zeros(256), s
        else:
            state = 0.001 * x + 0.999 * state
        total = 0.001 * np.array(h) + 0.999 * total
        assert means[frame] == pytest.approx(state, rel=1e-9)
        assert bins[frame][:4] == pytest.approx((total * 100 / total.sum())[:4].tolist(), rel=1e-9)


def test_a_carry_is_one_row_per_chunk(spark):
    table = spark.range(0, 1000).select(F.lit("a").alias("clip_id"), F.col("id").cast("int").alias("frame_idx"), F.col("id").cast("double").alias("x"))
    ends = table.where("frame_idx % 10 = 9").select("clip_id", F.expr("frame_idx div 10").alias("_chunk"), "x")
    for forward in (True, False):
        carry = {r["_chunk"]: r.x_in for r in O.fold_carries(ends, ["clip_id"], ["x"], 0.5, forward).collect()}
        assert len(carry) == 100
        state = 0.0
        for c in range(100) if forward else range(99, -1, -1):
            state = 0.5 * state + c * 10 + 9
            assert carry[c + (1 if forward else -1)] == pytest.approx(state)


def test_short_layer_and_missing_parameters_fail(spark, small):
    base, enhancement, params = layers.composite_inputs(spark, small)
    with pytest.raises(Exception, match="enhancement layer ends early"):
        C.composite(base, enhancement.where("idx < 1000"), params).agg(F.sum("out16")).collect()
    with pytest.raises(Exception, match="no parameters"):
        C.composite(base, enhancement, params.where("false")).agg(F.sum("out16")).collect()


def test_packed_layers_fail_alike_and_move_no_sample(spark, small):
    base, enhancement, params = layers.composite_inputs(spark, small)
    lower, upper = layers.packed(base, "bl16"), layers.packed(enhancement, "el16")
    with pytest.raises(Exception, match="ends early"):
        C.composite_planes(lower, layers.packed(enhancement.where("idx < 1000"), "el16"), params).count()
    with pytest.raises(Exception, match="ends early"):
        C.composite_planes(lower, upper.where("frame_idx > 0"), params).count()
    with pytest.raises(Exception, match="no parameters"):
        C.composite_planes(lower, upper, params.where("false")).count()
    stored = spark.createDataFrame([], lower.schema)
    plan = C.composite_planes(stored, spark.createDataFrame([], upper.schema), params)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.split("MapInPandas")[0].lower() and "idx" not in plan.split("\n")[0].replace("frame_idx", "")


def test_median_of_planes(spark):
    planes = raw_planes(spark, 9, 7)
    some = crops(spark, "a")
    got = readers.samples_from_planes(P.median3_planes(planes, some)).select(*FRAME, "x", "y", "y_code")
    want = grain.median3(readers.samples_from_planes(planes), some).select(*FRAME, "x", "y", "y_code")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("options", [{}, {"peak_estimator": "robust", "denoise": "median3"}, {"sample_rate": 2}])
def test_whole_analysis_of_planes_equals_samples(spark, options):
    planes = raw_planes(spark, 8, 6, frames=7)
    o = Options(scene_threshold=5.0, min_scene_length=2, **options)
    results = [analyze(given, crops(spark, "a"), o) for given in (planes, readers.samples_from_planes(planes))]
    heads, frames = ([sorted(map(tuple, getattr(r, part).select(*columns).collect())) for r in results] for part, columns in (
        ("headers", ("clip_id", "frame_count", "scene_count", "maxcll", "maxfall", "avgfall")), ("frames", ("clip_id", "frame_idx", "target_nits")),
    ))
    assert heads[0] == heads[1] and frames[0] == frames[1]
    assert [h[0] for h in heads[0]] == ["a", "b"] and len(frames[0]) == 14


def test_headers_alone_smooth_no_target(spark, monkeypatch):
    from lumaspark.plans import analyze as plan

    monkeypatch.setattr(plan, "with_targets", lambda *a: pytest.fail("targets were worked out"))
    planes = raw_planes(spark, 8, 6, frames=3)
    assert analyze(planes, None, Options()).headers.count() == 2


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage_dir(Session())


def test_many_shuffled_frames_in_one_batch_and_duplicates(spark, tmp_path):
    n = 50_000
    frames = spark.range(n).union(spark.createDataFrame([(5,), (n // 2,)], "id BIGINT")).select(
        F.lit("a").alias("clip_id"), F.col("id").cast("int").alias("frame_idx"), F.array(F.lit(1.0), F.lit(2.0)).alias("lum_hist"),
        (F.col("id") % 700).cast("int").alias("raw_target"), F.timestamp_seconds(F.col("id") + 1_704_067_200).alias("ts"),
    ).orderBy(F.xxhash64("frame_idx")).coalesce(1)
    frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    live = L.live_cuts_and_targets(stream, delay="30 days", max_delta=50)
    out = str(tmp_path / "out")
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / uuid.uuid4().hex)).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == n and got.agg(F.count_distinct("frame_idx")).first()[0] == n
    assert got.agg(F.max("dropped")).first()[0] == 2


def test_side_file_candidates_are_made_after_an_exchange(spark):
    """One small file of clips is not multiplied in the one task that reads it."""
    from lumaspark.sources import catalog

    clips = spark.createDataFrame([("a", "d/x.mkv")], "clip_id STRING, path STRING")
    found = catalog.find_side_files(clips, spark.createDataFrame([("d/x.measurements",)], "path STRING"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [clip_id" in plan and plan.index("Generate") < plan.index("RepartitionByExpression")
    assert [tuple(r) for r in found.collect()] == [("a", "d/x.measurements")]
