"""The recursive median over chunks against the loop over a scene."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspark.operators import smoothing as S

ROWS = "clip_id STRING, scene_id INT, frame_idx INT, scene_pos INT, lum_hist ARRAY<DOUBLE>"


def loop(hists, window):
    history, out = [], []
    for hist in hists:
        if history:
            hist = np.median(np.stack([*history, hist]), axis=0)
            if hist.sum() > 0:
                hist = hist * (100.0 / hist.sum())
        history = [*history, hist][-(window - 1):]
        out.append(hist)
    return np.array(out)


def scenes(seed):
    rng = np.random.default_rng(seed)
    noisy = rng.random((700, 6))
    fading = np.linspace(0, 1, 300)[:, None] * np.arange(6) + 1
    # Converging from both sides, the median never stands still.
    swinging = 10 + np.array([[(-1) ** (i + k) / (1 + i / 50) for k in range(6)] for i in range(400)])
    scaled = [h * (100 / h.sum(axis=1, keepdims=True)) for h in (noisy, fading, swinging)]
    dark = np.concatenate([scaled[0][:90], np.zeros((200, 6)), scaled[0][90:130]])
    return {("a", 0): scaled[0], ("a", 1): scaled[1], ("b", 0): scaled[2], ("b", 1): dark, ("c", 0): scaled[0][:1], ("c", 1): scaled[0][:33]}


@pytest.mark.parametrize("window", [2, 3, 4, 5, 40])
def test_median_over_chunks_equals_the_loop(spark, window):
    given = scenes(window)
    rows = [(clip, scene, i, i, h.tolist()) for (clip, scene), hists in given.items() for i, h in enumerate(hists)]
    got = {key: {} for key in given}
    for r in S.median_histogram(spark.createDataFrame(rows, ROWS).repartition(4), window, chunk=32).collect():
        got[r.clip_id, r.scene_id][r.scene_pos] = r.lum_hist
    for key, hists in given.items():
        np.testing.assert_allclose([got[key][i] for i in range(len(hists))], loop(hists, window), rtol=0, atol=1e-7)


def test_median_of_one_long_scene_is_spread(spark):
    """A scene of a hundred thousand frames: chunks over all tasks, and the loop's values."""
    n = 100_000
    bins = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 10.0 for k in range(4)])
    total = F.aggregate("lum_hist", F.lit(0.0), lambda a, v: a + v)
    df = spark.range(n).select(F.lit("a").alias("clip_id"), F.lit(0).alias("scene_id"), F.col("id").cast("int").alias("frame_idx"), F.col("id").cast("int").alias("scene_pos"), bins.alias("lum_hist"))
    df = df.withColumn("lum_hist", F.transform("lum_hist", lambda v: v * 100.0 / total))
    out = S.median_histogram(df, 3)
    files = out.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < n / 2
    got = np.array([r.lum_hist for r in out.orderBy("scene_pos").collect()])
    want = loop([np.array(r.lum_hist) for r in df.orderBy("scene_pos").collect()], 3)
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-7)
