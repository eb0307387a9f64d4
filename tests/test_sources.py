"""Raw files in ranges, and ordered text sinks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspark import schemas
from lumaspark.sources import files, ordered_text, raw_video, readers, writers


def planes(spark, clips, width=6, height=4):
    rng = np.random.default_rng(4)
    site = ((width + 1) // 2) * ((height + 1) // 2)
    pack = lambda n: bytearray(rng.integers(64, 940, n).astype("<u2").tobytes())
    rows = [(clip, i, width, height, pack(width * height), pack(site), pack(site)) for clip, numbers in clips.items() for i in numbers]
    return spark.createDataFrame(rows, schemas.PLANES)


@pytest.mark.parametrize("layout", raw_video.LAYOUTS)
@pytest.mark.parametrize("size", [(6, 4), (5, 3)])
def test_raw_round_trip_in_segments(spark, tmp_path, layout, size):
    """Gaps, names that no file may have, and several files per clip."""
    given = planes(spark, {"a": range(10), "b/c@1.x": [3, 4, 9]}, *size)
    path = str(tmp_path / "raw")
    raw_video.write_raw(given, path, *size, layout, frames_per_file=4)
    told = files.manifest(path)
    assert [p["frames"] for p in told["parts"]] == [4, 4, 2, 1, 1, 1] and told["layout"] == layout
    assert not os.path.exists(f"{path}/_pending")
    back = raw_video.read_raw(spark, path, *size, layout, frames_per_task=3)
    assert sorted(map(tuple, back.collect())) == sorted((r.clip_id, *map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r[1:])) for r in given.collect())


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    given = planes(spark, {"a": range(12)})
    raw_video.write_raw(given, str(tmp_path), 6, 4, frames_per_file=12)
    assert len(files.listed(str(tmp_path))) == 1
    back = raw_video.read_raw(spark, str(tmp_path), 6, 4, frames_per_task=5)
    tasks = back.select("frame_idx", F.spark_partition_id().alias("task")).groupBy("task").agg(F.min("frame_idx"), F.max("frame_idx"))
    assert sorted(tuple(r)[1:] for r in tasks.collect()) == [(0, 4), (5, 9), (10, 11)]


def test_filters_and_columns_reach_the_file(spark, tmp_path):
    """What isn't asked for isn't read: the file of clip b ends within a frame after the plan was made."""
    raw_video.write_raw(planes(spark, {"a": range(8), "b": range(8)}), str(tmp_path), 6, 4, frames_per_file=8)
    back = raw_video.read_raw(spark, str(tmp_path), 6, 4, columns=["clip_id", "frame_idx", "luma"], frames_per_task=2)
    wanted = back.where((F.col("clip_id") == "a") & (F.col("frame_idx") >= 3) & (F.col("frame_idx") < 6))
    assert wanted.rdd.getNumPartitions() == 2
    assert sorted((r.frame_idx, len(r.luma)) for r in wanted.collect()) == [(3, 48), (4, 48), (5, 48)]
    assert back.where("clip_id IN ('b', 'z')").count() == 8 and back.where("clip_id = 'z'").count() == 0
    assert back.where("frame_idx = 7 AND length(luma) = 48").count() == 2


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse: 90 frames of 3840 x 2160, of which one holds samples."""
    shape = raw_video.Shape(3840, 2160, "planar")
    with open(tmp_path / "long.yuv", "wb") as out:
        out.truncate(90 * shape.frame_bytes)
        out.seek(88 * shape.frame_bytes)
        out.write(np.full(shape.luma, 700, "<u2").tobytes())
    assert os.path.getsize(tmp_path / "long.yuv") > 1 << 31
    back = raw_video.read_raw(spark, str(tmp_path), 3840, 2160, columns=["frame_idx", "luma"])
    assert back.select("frame_idx").distinct().count() == 90
    late = back.where("frame_idx >= 87").select("frame_idx", F.hex(F.substring("luma", 1, 2)).alias("head"), F.length("luma").alias("n"))
    assert sorted(map(tuple, late.collect())) == [(87, "0000", 2 * shape.luma), (88, "BC02", 2 * shape.luma), (89, "0000", 2 * shape.luma)]


def test_broken_raw_data_fails(spark, tmp_path):
    (tmp_path / "film.yuv").write_bytes(b"\0" * 100)
    with pytest.raises(Exception, match="28 bytes after frame 0 are no whole 6x4 frame"):
        raw_video.read_raw(spark, str(tmp_path), 6, 4).count()
    with pytest.raises(Exception, match="no 8x4 frame|is 6x4"):
        raw_video.write_raw(planes(spark, {"a": [0]}), str(tmp_path / "w"), 8, 4)
    with pytest.raises(Exception, match="frame 0 twice"):
        raw_video.write_raw(planes(spark, {"a": [0, 0]}), str(tmp_path / "x"), 6, 4)
    assert not os.path.exists(tmp_path / "x" / files.MANIFEST)


def test_what_a_lost_task_wrote_is_not_read(spark, tmp_path):
    raw_video.write_raw(planes(spark, {"a": range(4)}), str(tmp_path), 6, 4, frames_per_file=2)
    pending = files.Pending(str(tmp_path))
    with pending.create()[1] as out:
        out.write(b"lost")
    assert raw_video.read_raw(spark, str(tmp_path), 6, 4).count() == 4


def test_ordered_parts_are_the_file(spark, tmp_path):
    """One clip with most of the rows is spread over tasks; parts in the order of their names are the clip's file."""
    n = 20_000
    rows = spark.range(n).select(F.when(F.col("id") < n - 10, "a=1/b%").otherwise("c").alias("clip_id"), F.col("id").cast("int").alias("frame"), F.when(F.col("id") % 3 > 0, F.col("id") * 2).alias("v"))
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        ordered_text.write_csv(rows.orderBy(F.rand(3)), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = files.manifest(path)["parts"]
    assert sum(p["rows"] for p in told) == n and max(p["rows"] for p in told) < n / 2
    folder = next(f for f in os.listdir(path) if "b%25" in f)
    text = "".join(open(f"{path}/{folder}/{name}").read() for name in sorted(os.listdir(f"{path}/{folder}")))
    assert text == "frame,v\n" + "".join(f"{i},{i * 2 if i % 3 else ''}\n" for i in range(n - 10))
    back = ordered_text.read_csv(spark, path, "frame INT, v BIGINT")
    assert back.exceptAll(rows.select("frame", "v", "clip_id")).count() == 0 and back.count() == n
    ordered_text.merged(spark, path, str(tmp_path / "whole"), ".csv")
    assert open(f"{tmp_path}/whole/{folder}.csv").read() == text


def test_a_write_that_did_not_commit_is_no_table(spark, tmp_path):
    with pytest.raises(Exception, match="lost"):
        rows = spark.range(100).select(F.lit("a").alias("clip_id"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("frame"))
        ordered_text.write_csv(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match=files.MANIFEST):
        ordered_text.read_csv(spark, str(tmp_path / "out"), "frame INT")


def test_documents_over_several_lines_and_per_clip(spark, tmp_path):
    text = """{"SceneInfo": [
      {"LuminanceParameters": {"MaxScl": [1, 2, 3], "LuminanceDistributions": {"DistributionValues": [4]}}}],
      "SceneInfoSummary": {"SceneFirstFrameIndex": [0]}}"""
    (tmp_path / "film.json").write_text(text)
    row = readers.read_hdr10plus(spark, str(tmp_path / "film.json")).first()
    assert row.clip_id == "film" and row.doc.SceneInfo[0].LuminanceParameters.MaxScl == [1, 2, 3] and row.doc.SceneInfoSummary.SceneFirstFrameIndex == [0]
    configs = spark.createDataFrame([("a", '{"x": 1}'), ("b/c", '{"y": "z"}')], "clip_id STRING, config STRING")
    for per_clip in (False, True):
        path = str(tmp_path / f"configs-{per_clip}")
        writers.write_configs(configs, path, per_clip)
        assert sorted(map(tuple, readers.read_configs(spark, path, per_clip).collect())) == [("a", '{"x": 1}'), ("b/c", '{"y": "z"}')]
