"""File listings as tables: side files and natural order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import natural_key

UNKNOWN = 4294967295  # sorts after every season and episode number
# Fixed names of temporary folders that a listing passes over.
TEMP_PREFIX = r"(^|/)[^/]*_temp_[^/]*(/|$)"
# Fixed candidate names of side files in order of preference.
MEASUREMENT_NAMES = (
    "{dir}measurements.bin",
    "{dir}{stem}.mkv.measurements",
    "{dir}{name}.measurements",
    "{dir}{stem}.measurements",
    "{dir}{stem}_measurements.bin",
)
DETAIL_NAMES = ("{dir}{stem}_mkv_Details.txt", "{dir}{stem}_Details.txt")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths under ``path``. Only file facts are read, not the contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def list_catalog(files: DataFrame, temp_pattern: str = TEMP_PREFIX) -> DataFrame:
    """Films of a listing with their sort keys: season, episode, natural key."""
    lower = F.lower("path")
    pattern = r"s(\d{1,2})e(\d{1,3})"

    def number(group: int):
        found = F.regexp_extract(lower, pattern, group)
        return F.when(found != "", found.cast("bigint")).otherwise(F.lit(UNKNOWN))

    return files.where(lower.endswith(".mkv") & ~F.col("path").rlike(temp_pattern)).select(
        "path", number(1).alias("season"), number(2).alias("episode"), natural_key("path").alias("natural_key")
    )


def natural_order(catalog: DataFrame) -> DataFrame:
    """Range-partitioned sort; nothing is gathered."""
    return catalog.orderBy("season", "episode", "natural_key", "path")


def find_side_files(clips: DataFrame, files: DataFrame, patterns=MEASUREMENT_NAMES) -> DataFrame:
    """First existing candidate per clip. ``clips`` has (clip_id, path), ``files`` has path.

    Every clip names its candidates, so the lookup is one equi join on the path.
    """
    folder = F.regexp_extract("path", r"^(.*/)?", 1)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")

    values = {"{dir}": folder, "{stem}": stem, "{name}": name}

    def fill(pattern: str):
        parts = [p for p in re.split(r"({\w+})", pattern) if p]
        return F.concat(*[values[p] if p in values else F.lit(p) for p in parts])

    # A listing stored small would be read, multiplied and sorted or broadcast by one task; dealt by clip first, its size is measured.
    wanted = clips.repartition("clip_id").select(
        "clip_id", F.posexplode(F.array(*[fill(p) for p in patterns])).alias("prio", "candidate")
    )
    hits = wanted.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hits.groupBy("clip_id").agg(F.min_by("candidate", "prio").alias("path"))
