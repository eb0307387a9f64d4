"""Text files in the order of a series, written by ranges.

Rows (folder, position, text) are dealt out by range, so a long series is spread over tasks like any other rows and no task holds it. A task
writes one part per folder, named by its first position; parts in the order of their names, the header before them,
are the file. Parts take their names when the job commits, and a manifest lists them. ``merged`` strings the parts of each folder together,
a few bytes at a time, for formats that must be one file.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files

FORMAT = "ordered_text"
SCHEMA = "folder STRING, position BIGINT, text STRING"
HEADER, PARTS = "header", "part-*"
COPY_BYTES = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class OrderedTextWriter(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.root, self.header, self.end = options["path"], options.get("header", ""), options.get("lineEnd", "\n")
        files.cleared(self.root, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        pending = files.Pending(self.root)
        parts: list[dict] = []
        out = None
        for batch in iterator:
            folders, positions, texts = (batch.column(c) for c in ("folder", "position", "text"))
            cuts = [i for i in range(batch.num_rows) if i == 0 or folders[i] != folders[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                folder = folders[a].as_py()
                if not parts or parts[-1]["folder"] != folder:
                    if out is not None:
                        out.close()
                    at, out = pending.create()
                    parts.append({"at": at, "folder": folder, "name": f"{folder}/part-{positions[a].as_py():019d}", "rows": 0})
                out.write("".join(t + self.end for t in texts.slice(a, b - a).to_pylist()).encode())
                parts[-1]["rows"] += b - a
        if out is not None:
            out.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        parts = [p for m in messages if m for p in m.parts]
        if self.header:
            pending = files.Pending(self.root)
            for folder in {p["folder"] for p in parts}:
                at, out = pending.create()
                with out:
                    out.write((self.header + self.end).encode())
                parts.append({"at": at, "folder": folder, "name": f"{folder}/{HEADER}", "rows": 0})
        files.commit(self.root, parts, {"header": self.header})

    def abort(self, messages: list[Written | None]) -> None:
        files.abort(self.root, [p for m in messages if m for p in m.parts])


class OrderedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> OrderedTextWriter:
        return OrderedTextWriter(self.options, overwrite)


def clip_folder(clip: Column) -> Column:
    """A clip's folder, as Spark names partitions. Only characters that a path may not hold are escaped."""
    escaped = clip
    for c in "%/:=?*\\#\"'{}[]^\x7f":
        escaped = F.replace(escaped, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit("clip_id="), escaped)


def write(rows: DataFrame, path: str, header: str = "", line_end: str = "\n") -> None:
    """``rows`` has folder, position (from 0) and text; positions are distinct within a folder."""
    rows.sparkSession.dataSource.register(OrderedText)
    dealt = rows.select("folder", F.col("position").cast("bigint").alias("position"), "text").repartitionByRange("folder", "position").sortWithinPartitions("folder", "position")
    dealt.write.format(FORMAT).mode("overwrite").option("header", header).option("lineEnd", line_end).save(path)


def write_csv(rows: DataFrame, path: str, position: str = "frame") -> None:
    """One file per clip with a header, ordered by ``position``; the clip is the folder and no column. Nulls are empty cells."""
    columns = [c for c in rows.columns if c != "clip_id"]
    cells = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    write(rows.select(clip_folder(F.col("clip_id")).alias("folder"), F.col(position).alias("position"), cells.alias("text")), path, ",".join(columns))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``write_csv``; ``schema`` names the columns of the file. A write that didn't commit has no manifest and fails."""
    files.manifest(path)
    return spark.read.schema(f"{schema}, clip_id STRING").option("pathGlobFilter", PARTS).csv(path)


def merged(spark: SparkSession, path: str, target: str, suffix: str) -> None:
    """One file ``folder + suffix`` in ``target`` per folder of a written path: its parts in order, copied piece by piece."""
    told = spark.createDataFrame([(p["folder"], p["name"]) for p in files.manifest(path)["parts"]], "folder STRING, name STRING")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = files.opened(path)
        pending = files.Pending(target)
        current, out = None, None
        made: list[tuple[str, str]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["folder"] != current:
                    if out is not None:
                        out.close()
                    current = row["folder"]
                    at, out = pending.create()
                    made.append((at, current + suffix))
                with source.open_input_stream(posixpath.join(root, row["name"])) as part:
                    while piece := part.read(COPY_BYTES):
                        out.write(piece)
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], names=["at", "name"])

    files.cleared(target, True)
    done = told.repartition("folder").sortWithinPartitions("folder", "name").mapInArrow(copy, "at STRING, name STRING")
    files.commit(target, [r.asDict() for r in done.collect()], {})
