"""Readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.transfer import unpack_code
from ..operators.checks import check_shots
from ..operators.planes import codes_of, there
from ..operators.ordered import previous_row, running_count

LINES_PER_CHUNK = 8192


def read_samples(
    spark: SparkSession,
    path: str,
    clips: list[str] | None = None,
    frames: tuple[int, int] | None = None,
    rect: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Pixel samples. Clip, frame range and rectangle become filters of the scan."""
    samples = spark.read.schema(schemas.SAMPLES).parquet(path)
    if clips is not None:
        samples = samples.where(F.col("clip_id").isin(*clips))
    if frames is not None:
        samples = samples.where(F.col("frame_idx").between(*frames))
    if rect is not None:
        x, y, width, height = rect
        samples = samples.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return samples


def read_by_frame(spark: SparkSession, *tables: str) -> list[DataFrame]:
    """Tables of ``writers.write_by_frame``. Joins on (clip, frame) and further keys may then use the buckets as they
    lie, which Spark leaves out unless told that a part of the keys will do; this is set for the session."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return [spark.table(t) for t in tables]


def samples_from_planes(planes: DataFrame) -> DataFrame:
    """Long samples of planes; each luma sample gets the codes of its chroma site. Holes give no row."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                width = int(row.width)
                luma = codes_of(row.luma).reshape(-1, width)
                sites = [codes_of(p).reshape(-1, (width + 1) // 2) for p in (row.cb, row.cr)]
                every, known = np.arange(width), there(luma)
                # Row by row: an output batch stays as small as one line of the picture.
                for y, codes in enumerate(luma):
                    columns = every if known is None else np.flatnonzero(known[y])
                    yield pd.DataFrame({
                        "clip_id": row.clip_id, "frame_idx": row.frame_idx, "x": columns, "y": y, "y_code": codes[columns],
                        "cb_code": sites[0][y // 2][columns // 2], "cr_code": sites[1][y // 2][columns // 2],
                    })

    return planes.mapInPandas(spread, schemas.SAMPLES)


def unpack_words(raw: DataFrame, layout: str) -> DataFrame:
    return raw.withColumn("code", unpack_code("raw", layout))


def read_reference_l1(spark: SparkSession, path: str, clip_from_path: bool = True) -> DataFrame:
    """Reference L1 files: ``frame,min_pq,max_pq,avg_pq``; a header only on the first line.

    Lines are read as text, since a header in the middle of a file is an error and not
    a header. Blank lines are skipped, further columns ignored; too few columns or a cell
    that is not a whole number fails the job.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("clip_id"),
        F.col("value"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return parse_reference_lines(lines if clip_from_path else lines.withColumn("clip_id", F.lit("reference")))


def parse_reference_lines(lines: DataFrame) -> DataFrame:
    """Reference rows from (clip_id, value, _line), the first line of a file having the lowest number."""
    first = lines.groupBy("clip_id").agg(F.min("_line").alias("_first"))
    marked = lines.join(first, "clip_id")
    header = (F.col("_line") == F.col("_first")) & F.col("value").startswith("frame")
    cells = F.split("value", ",")

    def cell(i: int, name: str):
        text = F.trim(F.get(cells, i))
        bad = F.raise_error(F.concat(F.lit(f"reference line without a valid {name}: "), F.col("value")))
        return F.when(text.rlike(r"^\+?[0-9]+$"), text.cast("int")).otherwise(bad.cast("int")).alias(name)

    return marked.where(~header & (F.trim("value") != "")).select(
        "clip_id", cell(0, "frame_idx"), cell(1, "min_pq"), cell(2, "max_pq"), cell(3, "avg_pq")
    )


def shot_starts(lines: DataFrame) -> DataFrame:
    """Numbered starts (clip_id, line, start) of shot-list lines (clip_id, line_no, value); blank lines go."""
    text = F.trim("value")
    # The cast is guarded as well: a filter may be evaluated after it.
    numbers = lines.where(text != "").select("clip_id", "line_no", F.when(text != "", text.cast("int")).alias("start"))
    counted = running_count(numbers, ["clip_id"], "line_no", F.lit(1), "line", LINES_PER_CHUNK)
    return counted.select("clip_id", (F.col("line") - 1).cast("int").alias("line"), "start")


def shots_from_starts(starts: DataFrame, counts: DataFrame, check: bool = True) -> DataFrame:
    """Half-open shots (clip_id, shot_id, start, end_excl); the end sentinel is dropped.

    With ``check`` a broken list fails the job; without it only lists that pass are returned.
    """
    broken = check_shots(starts, counts)
    listed = starts.join(counts.select("clip_id", "frame_count"), "clip_id").where(F.col("start") < F.col("frame_count"))
    mirrored = listed.withColumn("_back", F.col("frame_count") - F.col("start"))
    ended = previous_row(mirrored, ["clip_id"], "_back", {"start": "_next"})
    shots = ended.select(
        "clip_id", F.col("line").cast("int").alias("shot_id"), F.col("start").cast("int").alias("start"),
        F.coalesce("_next", "frame_count").cast("int").alias("end_excl"),
    )
    bad = broken.select("clip_id").distinct()
    if not check:
        return shots.join(bad, "clip_id", "left_anti")
    marked = shots.join(bad.withColumn("_bad", F.lit(True)), "clip_id", "left")
    return marked.where(
        F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("broken shot list of clip "), F.col("clip_id"))).cast("boolean"))
        .otherwise(F.lit(True))
    ).drop("_bad")


def read_shots(spark: SparkSession, path: str, counts: DataFrame, check: bool = True) -> DataFrame:
    lines = spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("clip_id"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )
    return shots_from_starts(shot_starts(lines), counts, check)


def parse_sidecar(documents: DataFrame, required_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Frame and scene rows of sidecar documents; any other version yields nothing."""
    valid = documents.where(F.col("version") == required_version)
    series = valid.select(
        "clip_id",
        F.posexplode(
            F.arrays_zip("frames.min_pq_12bit", "frames.avg_luma_pq_12bit", "frames.avg_max_rgb_pq_12bit")
        ).alias("frame_idx", "_f"),
    ).select("clip_id", "frame_idx", *[F.col(f"_f.{c}").alias(c) for c in ("min_pq_12bit", "avg_luma_pq_12bit", "avg_max_rgb_pq_12bit")])
    scenes = valid.select("clip_id", F.posexplode("scenes").alias("scene_id", "_s")).select("clip_id", "scene_id", "_s.*")
    return series, scenes


def read_sidecar_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SIDECAR).option("recursiveFileLookup", True).json(path)


def read_sidecar(spark: SparkSession, path: str, required_version: int = 1, require_scenes: bool = False):
    """(frames, scenes) of the sidecars under ``path``. With ``require_scenes`` documents without
    scenes are passed over too, so that the caller can fall back."""
    documents = read_sidecar_documents(spark, path)
    if require_scenes:
        documents = documents.where(F.size("scenes") > 0)
    return parse_sidecar(documents, required_version)


def read_hdr10plus(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, doc) per document; a document may span lines."""
    documents = spark.read.schema(schemas.HDR10PLUS).option("multiLine", True).json(path)
    return documents.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("clip_id"),
        F.struct("SceneInfo", "SceneInfoSummary").alias("doc"),
    )


def read_hdr10plus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, doc) of files that hold a document per line with its ``clip_id``, as a catalogue is kept."""
    documents = spark.read.schema(f"clip_id STRING, {schemas.HDR10PLUS}").json(path)
    return documents.select("clip_id", F.struct("SceneInfo", "SceneInfoSummary").alias("doc"))


def read_configs(spark: SparkSession, path: str, per_clip: bool = False) -> DataFrame:
    """(clip_id, config) as written by ``writers.write_configs``."""
    if per_clip:
        return spark.read.schema("value STRING, clip_id STRING").text(path).select("clip_id", F.col("value").alias("config"))
    return spark.read.schema("clip_id STRING, config STRING").json(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, track_json) per container-metadata file."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("clip_id"),
        F.col("value").alias("track_json"),
    )


def read_measurements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, scenes, frames) as written by ``writers.write_measurements``."""
    return tuple(
        spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in (("headers", schemas.HEADERS), ("scenes", schemas.SCENES), ("frames", schemas.FRAMES))
    )


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame_idx, doc) of exported per-frame metadata lines."""
    lines = spark.read.schema(f"clip_id STRING, frame_idx INT, doc STRUCT<{_fields(schemas.EXPORTED)}>").json(path)
    return lines


def _fields(ddl: str) -> str:
    """Top-level fields of a DDL string in struct notation."""
    inner = StructType.fromDDL(ddl).simpleString()
    return inner[len("struct<"):-1]
