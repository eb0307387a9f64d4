"""Writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators.metadata import shots_from_scenes
from ..operators.rollups import frame_l1, scene_l1
from ..operators.scoring import delta_rows
from . import ordered_text

SIDECAR_VERSION = 1
SECTION = 1 << 40  # positions of one part of a sidecar
STATS_COLUMNS = ("selected_pq", "raw_max_pq", "percentile_pq", "robust_pq", "sigma_pq", "correction_pq")


def write_by_frame(rows: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Samples, planes, layers or parameters as a table bucketed by (clip, frame) and sorted inside.

    Per-frame aggregations and windows on the table need no shuffle, and frame filters skip row groups. Tables of the same number of
    buckets, read by ``readers.read_by_frame``, join without one: chroma to luma, one layer to another.
    """
    order = [c for c in ("plane", "y", "x", "cy", "cx", "idx") if c in rows.columns]
    writer = rows.write.bucketBy(buckets, "clip_id", "frame_idx").sortBy("clip_id", "frame_idx", *order).format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def write_samples(samples: DataFrame, table: str, buckets: int) -> None:
    write_by_frame(samples, table, buckets)


def sidecar_pieces(framed: DataFrame, crops: DataFrame, **options) -> DataFrame:
    """One nested document per clip (options, crop, scene rows, columnar frame codes) as pieces of text: (folder, position, text).

    A document is as long as its clip, so it is never a value: each scene and each code of each series is a row, and what lies between them too.
    """
    settings = {
        "min_percentile": 0.1, "denoise_mode": "off", "peak_domain": "max-rgb",
        "peak_estimator": "max", "peak_percentile": 99.99, **options,
    }
    names = ("start", "end", "min_pq_12bit", "avg_luma_pq_12bit", "avg_max_rgb_pq_12bit", "max_pq_12bit")
    codes = ("min_pq_12bit", "avg_luma_pq_12bit", "avg_max_rgb_pq_12bit")
    scenes, frames = scene_l1(framed), frame_l1(framed)
    clips = frames.groupBy("clip_id").agg(F.min("frame_idx").alias("_frame")).join(scenes.groupBy("clip_id").agg(F.min("start").alias("_scene")), "clip_id")
    facts = clips.join(crops.select("clip_id", F.col("rect").alias("crop")), "clip_id", "left")
    head = F.to_json(F.struct(
        "clip_id", F.lit(SIDECAR_VERSION).alias("version"),
        *[F.lit(settings[k]).alias(k) for k in ("min_percentile", "denoise_mode", "peak_domain", "peak_estimator", "peak_percentile")], "crop",
    ))

    def between(section: int, text) -> DataFrame:
        return facts.select("clip_id", F.lit(section * SECTION).alias("position"), text.alias("text"))

    def series(rows: DataFrame, section: int, at: str, first: str, text) -> DataFrame:
        comma = F.when(F.col(at) == F.col(first), "").otherwise(",")
        return rows.join(clips, "clip_id").select("clip_id", (F.col(at) + section * SECTION + 1).alias("position"), F.concat(comma, text).alias("text"))

    open_head = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"scenes":['))
    pieces = [facts.withColumn("_head", head).select("clip_id", F.lit(0).cast("bigint").alias("position"), open_head.alias("text"))]
    pieces.append(series(scenes, 0, "start", "_scene", F.to_json(F.struct(*names))))
    for i, c in enumerate(codes):
        pieces.append(between(i + 1, F.lit(('],"frames":{' if i == 0 else "],") + f'"{c}":[')))
        pieces.append(series(frames, i + 1, "frame_idx", "_frame", F.col(c).cast("string")))
    pieces.append(between(len(codes) + 1, F.lit("]}}\n")))
    every = reduce(DataFrame.unionByName, pieces)
    return every.select(ordered_text.clip_folder(F.col("clip_id")).alias("folder"), F.col("position").cast("bigint").alias("position"), "text")


def write_sidecar(framed: DataFrame, crops: DataFrame, path: str, **options) -> None:
    """``clip_id=….json`` per clip, written in parts under ``path/_parts`` and then strung together."""
    ordered_text.write(sidecar_pieces(framed, crops, **options), f"{path}/_parts", line_end="")
    ordered_text.merged(framed.sparkSession, f"{path}/_parts", f"{path}/documents", ".json")


def stats_rows(stats: DataFrame) -> DataFrame:
    """Frame statistics with 12 decimals."""
    return stats.select(
        "clip_id",
        F.col("frame_idx").alias("frame"),
        *[F.format_string("%.12f", F.col(c)).alias(c) for c in STATS_COLUMNS],
        "n_eff",
    )


def write_peak_stats(stats: DataFrame, path: str) -> None:
    """One file per clip in frame order, in parts."""
    ordered_text.write_csv(stats_rows(stats), path)


def write_deltas(joined: DataFrame, path: str, with_sidecar: bool) -> None:
    ordered_text.write_csv(delta_rows(joined, with_sidecar), path)


def write_measurements(headers: DataFrame, scenes: DataFrame, frames: DataFrame, path: str) -> None:
    for name, table in (("headers", headers), ("scenes", scenes), ("frames", frames)):
        table.write.mode("overwrite").partitionBy("clip_id").parquet(f"{path}/{name}")


def config_documents(
    static: DataFrame,
    trims: str = "100,600,1000",
    cm_version: str | None = "V40",
    content_type: int = 1,
    reference_mode: bool = False,
    primaries: DataFrame | None = None,
    level5: DataFrame | None = None,
    scene_l1_rows: DataFrame | None = None,
) -> DataFrame:
    """(clip_id, config JSON) per clip: level 6, optional level 5, default blocks and shots.

    A missing luminance value fails the job: run ``metadata.with_defaults`` first.
    """
    def required(name: str):
        return F.coalesce(F.col(name), F.raise_error(F.lit(f"missing static metadata value {name}")).cast("double"))

    rows = static.select("clip_id", *[required(c).alias(c) for c in ("max_dml", "min_dml", "max_cll", "max_fall")])
    fields = [F.lit("8.1").alias("profile"), X.l6_block("max_dml", "min_dml", "max_cll", "max_fall").alias("level6")]
    if level5 is not None:
        rows = rows.join(level5.select("clip_id", F.struct("left", "right", "top", "bottom").alias("_l5")), "clip_id", "left")
        fields.append(F.when(F.col("_l5").isNotNull(), X.l5_block(F.col("_l5"))).alias("level5"))
    if cm_version == "V40":
        if primaries is not None:
            rows = rows.join(primaries.select("clip_id", "primary_index"), "clip_id", "left")
            primary = F.coalesce("primary_index", F.lit(2))
        else:
            primary = F.lit(2)
        l2 = F.transform(X.trim_blocks(X.trim_targets(F.lit(trims))), lambda b: F.to_json(F.struct(b.alias("Level2"))))
        rest = F.array(
            F.to_json(F.struct(X.l9_block(primary).alias("Level9"))),
            F.to_json(F.struct(X.l11_block(content_type, reference_mode).alias("Level11"))),
        )
        rows = rows.withColumn("_blocks", F.concat(l2, rest))
        fields.append(F.lit("V40").alias("cm_version"))
    if scene_l1_rows is not None:
        rows = rows.join(shots_from_scenes(scene_l1_rows), "clip_id", "left")
        has_shots = F.col("shots").isNotNull()
        fields += [
            F.col("length"), F.when(has_shots, F.lit("V29")).alias("l1_avg_pq_cm_version"), F.col("shots"),
        ]
    rows = rows.withColumn("_doc", F.to_json(F.struct(*fields)))
    if cm_version != "V40":
        return rows.select("clip_id", F.col("_doc").alias("config"))
    # Blocks differ in shape, so they are joined as text and spliced in before the closing brace.
    body = F.expr("substring(_doc, 1, length(_doc) - 1)")
    blocks = F.concat(F.lit(',"default_metadata_blocks":['), F.array_join("_blocks", ","), F.lit("]}"))
    return rows.select("clip_id", F.concat(body, blocks).alias("config"))


def write_configs(configs: DataFrame, path: str, per_clip: bool = False) -> None:
    """One line per clip with its configuration, many to a file, or with ``per_clip`` a folder for each (for the tools that read them; a few clips)."""
    if per_clip:
        configs.select("config", "clip_id").write.mode("overwrite").partitionBy("clip_id").text(path)
    else:
        configs.select("clip_id", "config").write.mode("overwrite").json(path)
