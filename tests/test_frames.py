"""Constructed frames with a known truth."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumaspark import schemas
from lumaspark.functions import geometry as G, transfer as T
from lumaspark.operators import crop as C, grain, measure, planes as P, samples as S
from lumaspark.sources import raw_video, readers

W, H = 160, 90


def frames_table(spark, clips):
    """Long samples of (clip, frame, luma, cb, cr) arrays."""
    rows = []
    for clip, frame, y, cb, cr in clips:
        yy, xx = np.mgrid[0:y.shape[0], 0:y.shape[1]]
        rows.append(pd.DataFrame({
            "clip_id": clip, "frame_idx": frame, "x": xx.ravel(), "y": yy.ravel(), "y_code": y.ravel(),
            "cb_code": np.repeat(np.repeat(cb, 2, 0), 2, 1)[:y.shape[0], :y.shape[1]].ravel(), "cr_code": np.repeat(np.repeat(cr, 2, 0), 2, 1)[:y.shape[0], :y.shape[1]].ravel(),
        }))
    return spark.createDataFrame(pd.concat(rows, ignore_index=True), schemas.SAMPLES)


def planes_table(spark, clips):
    pack = lambda a: a.astype("<u2").tobytes()
    rows = [(c, f, y.shape[1], y.shape[0], pack(y), pack(cb), pack(cr)) for c, f, y, cb, cr in clips]
    return spark.createDataFrame(rows, schemas.PLANES)


def grey(height=H, width=W):
    return np.full(((height + 1) // 2, (width + 1) // 2), 512)


def code_of(nits):
    return round(64 + 876 * T.nits_to_pq_number(nits))


@pytest.fixture(scope="module")
def clips():
    rng = np.random.default_rng(7)
    out = [(f"n{n}", 0, np.full((H, W), code_of(n)), grey(), grey()) for n in (100, 1000, 4000)]
    y = np.full((H, W), 500)
    out.append(("red", 0, y, grey(), np.full(grey().shape, 700)))
    noisy = np.clip(np.rint(700 + 4 * rng.standard_normal((H * 2, W * 2))), 64, 940).astype(int)
    out.append(("grain", 0, noisy, grey(H * 2, W * 2), grey(H * 2, W * 2)))
    floor = np.full((H, W), 300)
    floor[3, 5] = 64
    out.append(("dark", 0, floor, grey(), grey()))
    return out


@pytest.mark.parametrize("form", ["samples", "planes"])
def test_known_peaks(spark, clips, form):
    if form == "samples":
        given = frames_table(spark, clips)
        diffs = grain.diff_histogram(grain.cross_quad_diffs(given))
        frames = measure.measure_frames(given, estimator="robust", diffs=diffs)
    else:
        frames = P.measure_planes(planes_table(spark, clips), estimator="robust")
    got = {r.clip_id: r for r in frames.collect()}
    quarter = 0.25 / 4095
    for n in (100, 1000, 4000):
        assert abs(got[f"n{n}"].peak_pq - (code_of(n) - 64) / 876) < quarter
        assert sum(got[f"n{n}"].lum_hist) == pytest.approx(100) and sum(got[f"n{n}"].hue_hist) == 0
    assert got["red"].peak_pq == pytest.approx(436 / 876 + 1.4746 * 188 / 896)
    assert got["red"].hue_hist[7] == pytest.approx(100)
    sigma = 4 / 876
    clean = (700 - 64) / 876
    assert abs(got["grain"].peak_pq - clean) * 4095 < 2 + 0.5 * sigma * 4095
    assert got["grain"].raw_max_pq - clean > 2 * sigma
    assert got["grain"].sigma_pq == pytest.approx(sigma, rel=0.1)
    assert got["dark"].min_pq == pytest.approx((300 - 64) / 876, abs=1 / 4095)


def test_minimum_without_percentile_sees_the_dark_sample(spark, clips):
    frames = P.measure_planes(planes_table(spark, clips), min_percentile=0.0)
    assert {r.clip_id: r.min_pq for r in frames.collect()}["dark"] == 0.0


def test_samples_and_planes_agree_inside_an_odd_crop(spark, clips):
    rects = spark.createDataFrame([(c, (3, 5, 41, 33)) for c, *_ in clips], f"clip_id STRING, rect {schemas.RECT}")
    long = S.crop_samples(frames_table(spark, clips), rects)
    a = {r.clip_id: r for r in measure.measure_frames(long, crops=rects).collect()}
    b = {r.clip_id: r for r in P.measure_planes(planes_table(spark, clips), crops=rects).collect()}
    for clip, row in a.items():
        other = b[clip]
        assert row.n == other.n == 41 * 33
        for field in ("peak_pq", "avg_pq", "avg_max_rgb_pq", "min_pq"):
            assert row[field] == pytest.approx(other[field], abs=1e-9)
        assert row.lum_hist == pytest.approx(other.lum_hist) and row.hue_hist == pytest.approx(other.hue_hist)
    d1 = grain.diff_histogram(grain.cross_quad_diffs(frames_table(spark, clips), rects))
    d2 = P.plane_diffs(planes_table(spark, clips), crops=rects)
    as_set = lambda df: {tuple(r) for r in df.select("clip_id", "band", "diff", "n").collect()}
    assert as_set(d1) == as_set(d2)


def test_strips_of_a_frame_add_up(spark, clips):
    y = clips[4][2]
    whole = planes_table(spark, [clips[4]])
    pack = lambda a: a.astype("<u2").tobytes()
    rows = [("grain", 0, y.shape[1], 60, r0, pack(y[r0:r0 + 60]), pack(grey(60, y.shape[1])), pack(grey(60, y.shape[1]))) for r0 in (0, 60, 120)]
    strips = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, width INT, height INT, row0 INT, luma BINARY, cb BINARY, cr BINARY")
    a, b = (P.measure_planes(t).first() for t in (whole, strips))
    assert a.n == b.n and a.peak_pq == b.peak_pq and a.avg_pq == pytest.approx(b.avg_pq) and a.lum_hist == b.lum_hist


def test_raw_files_of_both_layouts(spark, tmp_path):
    rng = np.random.default_rng(2)
    y, cb, cr = rng.integers(64, 940, (2, 8, 6)), rng.integers(64, 960, (2, 4, 3)), rng.integers(64, 960, (2, 4, 3))
    planar, packed = b"", b""
    for i in range(2):
        planar += b"".join((p[i] | 0x8000).astype("<u2").tobytes() for p in (y, cb, cr))
        woven = np.stack([cb[i].ravel(), cr[i].ravel()], axis=1)
        packed += b"".join((p << 6).astype("<u2").tobytes() for p in (y[i], woven))
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    (tmp_path / "a" / "film.yuv").write_bytes(planar)
    (tmp_path / "b" / "film.yuv").write_bytes(packed)
    a = readers.samples_from_planes(raw_video.read_raw(spark, str(tmp_path / "a"), 6, 8)).collect()
    b = readers.samples_from_planes(raw_video.read_raw(spark, str(tmp_path / "b"), 6, 8, "p010")).collect()
    assert sorted(a) == sorted(b) and len(a) == 2 * 48
    assert {(r.frame_idx, r.y, r.x): (r.y_code, r.cb_code) for r in a}[(1, 5, 4)] == (y[1, 5, 4], cb[1, 2, 2])


def test_letterbox_is_found_and_voted(spark):
    black, white = np.full((H, W), 64), np.full((H, W), 64)
    white[12:78] = 900
    clips = [("box", i, black if i < 2 else white, grey(), grey()) for i in range(6)]
    given = frames_table(spark, clips)
    facts = spark.createDataFrame([("box", W, H, 0, 6000)], "clip_id STRING, width INT, height INT, start_tick BIGINT, duration BIGINT")
    rects = {r.frame_idx: tuple(r.rect) for r in C.detect_crop(given, facts).collect()}
    assert rects[0] == (0, 0, W, H) and rects[5] == (0, 12, W, 66)
    timed = given.select("clip_id", "frame_idx").distinct().withColumn("pts", F.col("frame_idx") * 1000)
    vote = C.probed_crop(given, facts, timed).first()
    assert tuple(vote.rect) == (0, 12, W, 66) and not vote.variable_ar and vote.candidate_count == vote.modal_count
    fallback = C.fallback_crop(given, facts).first()
    assert fallback.from_frame == 2 and tuple(fallback.rect) == (0, 12, W, 66)


def test_votes(spark):
    def vote(*rects):
        rows = [("c", i, r) for i, r in enumerate(rects)]
        return C.vote_crop(spark.createDataFrame(rows, f"clip_id STRING, ord INT, rect {schemas.RECT}")).first()

    jitter = vote((0, 12, 160, 66), (0, 12, 160, 64), (0, 10, 160, 68), (0, 14, 160, 62))
    assert tuple(jitter.rect) == (0, 10, 160, 68) and (jitter.cluster_count, jitter.modal_count) == (1, 4)
    two = vote((0, 12, 160, 66), (0, 12, 160, 66), (0, 0, 160, 90))
    assert tuple(two.rect) == (0, 0, 160, 90) and two.variable_ar and (two.cluster_count, two.modal_count) == (2, 2)
    # A chain whose ends do not match each other is still one cluster.
    chain = vote(*[(0, i * 2, 160, 40) for i in range(30)])
    assert chain.cluster_count == 1 and tuple(chain.rect) == (0, 0, 160, 98)


def test_votes_equal_a_plain_loop(spark):
    """Clusters over cells are those of all pairs, with negative edges and matches across every kind of border."""
    rng = np.random.default_rng(17)
    rects = {clip: sorted({tuple(int(v) for v in rng.integers(-span, span, 4)) for _ in range(n)}) for clip, n, span in (("a", 150, 6), ("b", 300, 9), ("c", 40, 3))}
    rows = [(clip, 1, i, r) for clip, found in rects.items() for i, r in enumerate(found)]
    distinct = spark.createDataFrame(rows, f"clip_id STRING, n INT, label INT, rect {schemas.RECT}")
    got = {(r.clip_id, tuple(r.rect)): r.label for r in C.cluster_labels(distinct, 2, 4).collect()}

    def near(a, b):
        ends = lambda r: (r[0], r[1], r[0] + r[2], r[1] + r[3])
        return all(abs(p - q) <= 2 for p, q in zip(ends(a), ends(b), strict=True))

    for clip, found in rects.items():
        label = list(range(len(found)))
        while True:
            new = [min(label[j] for j in range(len(found)) if near(found[i], found[j])) for i in range(len(found))]
            if new == label:
                break
            label = new
        assert [got[clip, r] for r in found] == label


def test_many_sizes_at_one_corner_give_few_edges(spark):
    n = 100_000
    rect = F.expr("named_struct('x', 0, 'y', 12, 'width', cast(id % 400 as int), 'height', cast(id div 400 as int))")
    distinct = spark.range(n).select(F.lit("a").alias("clip_id"), F.lit(1).alias("n"), F.col("id").cast("int").alias("label"), rect.alias("rect"))
    members, edges = C.crop_cells(distinct, 2)
    assert members.count() == n
    cells = members.select("node").distinct().count()
    assert cells == 134 * 84 and edges.count() <= 8 * cells


def test_median_leaves_the_border(spark):
    y = np.arange(48).reshape(6, 8) * 7 % 31 + 100
    rect = spark.createDataFrame([("c", (1, 1, 6, 5))], f"clip_id STRING, rect {schemas.RECT}")
    got = {(r.y, r.x): r.y_code for r in grain.median3(frames_table(spark, [("c", 0, y, grey(6, 8), grey(6, 8))]), rect).collect()}
    for (row, column), value in got.items():
        inner = 1 < column < 6 and 1 < row < 5
        assert value == (np.sort(y[row - 1:row + 2, column - 1:column + 2].ravel())[4] if inner else y[row, column])


def test_rect_helpers(spark):
    row = spark.range(1).select(
        G.scale_rect(G.rect(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), 2).alias("up"), G.shrink_rect(G.rect(F.lit(5), F.lit(9), F.lit(3), F.lit(4)), 4).alias("down")
    ).first()
    assert tuple(row.up) == (2, 4, 6, 8) and tuple(row.down) == (1, 2, 2, 2)


def test_cuts_come_out_in_order(spark):
    from lumaspark.operators import scenes

    rows = [(clip, frame) for frame in (30, 2, 111, 7) for clip in ("b", "a10", "a2")]
    cuts = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT").repartition(3)
    assert [tuple(r) for r in scenes.sort_cuts(cuts).collect()] == sorted(rows)


def test_cells_are_dealt_a_few_times_only(spark):
    """A cell goes to its block and to those before it that it borders on, not to every cell around it."""
    rows = [(f"c{i}", j, (3 * j, j % 4, 100 + j % 3, 60), 1) for i in range(500) for j in range(4)]
    distinct = spark.createDataFrame(rows, f"clip_id STRING, label INT, rect {schemas.RECT}, n INT")
    members, edges = C.crop_cells(distinct, 2)
    plan = edges._jdf.queryExecution()
    edges.write.format("noop").mode("overwrite").save()
    assert "SortMergeJoin" not in plan.executedPlan().toString() and "BroadcastHashJoin" not in plan.executedPlan().toString()
    assert members.count() == 2000
