"""Raw 4:2:0 files as a Spark data source.

A file holds frames of 16-bit little-endian words: planar ones Y, U and V one after the other, P010 ones Y and then U and V interleaved, with the code in
the high bits. Files are cut into ranges of frames, so one file of any size is read by many tasks and no
file is ever one value. Clip and frame filters drop files and ranges before a byte is read; a schema without chroma reads the luma words only, one without planes none at all.

A file's stem is its clip. ``clip@120.yuv`` holds the frames of the clip from 120 on, so that a clip may be stored in
segments; the writer stores it so. A file that ends within a frame fails the job.

Frames that are known in part are stored and read with ``holes``: the word 0xFFFF is a place without a sample. Without it the word is a
code like any other, and the writer refuses such frames.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.planes import HOLE
from . import files

FORMAT = "raw_planes"
LAYOUTS = ("planar", "p010")
PART_BYTES = 64 << 20  # of a file, in one task
BATCH_BYTES = 16 << 20
FRAMES_PER_FILE = 240
NAME = re.compile(r"(.+?)(?:@(\d+))?(?:\.[^./@]*)?")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Shape:
    width: int
    height: int
    layout: str
    holes: bool = False

    def __post_init__(self):
        if self.layout not in LAYOUTS:
            raise ValueError(f"unknown layout {self.layout!r}")
        self.luma = self.width * self.height
        self.site = ((self.width + 1) // 2) * ((self.height + 1) // 2)
        self.frame_bytes = 2 * (self.luma + 2 * self.site)

    @classmethod
    def of(cls, options: Mapping[str, str]) -> Shape:
        return cls(int(options["width"]), int(options["height"]), options.get("layout", "planar"), options.get("holes", "false").lower() == "true")

    def planes(self, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes of the planes that the words hold: luma, and both chroma planes if they are there."""
        codes = words >> 6 if self.layout == "p010" else words & 1023
        if self.holes:
            codes = np.where(words == HOLE, words, codes)
        if len(codes) == self.luma:
            return (codes,)
        chroma = codes[self.luma :]
        parts = (chroma[0::2], chroma[1::2]) if self.layout == "p010" else (chroma[: self.site], chroma[self.site :])
        return codes[: self.luma], *parts

    def words(self, luma: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
        """The stored words of a frame."""
        if (len(luma), len(cb), len(cr)) != (self.luma, self.site, self.site):
            raise ValueError(f"planes of {len(luma)}, {len(cb)} and {len(cr)} samples are no {self.width}x{self.height} frame")
        if not self.holes and any(HOLE in p for p in (luma, cb, cr)):
            raise ValueError("a frame with holes is stored with holes=True only")
        if self.layout == "planar":
            return np.concatenate([luma, cb, cr])
        codes = np.concatenate([luma, np.stack([cb, cr], axis=1).reshape(-1)])
        return np.where(codes == HOLE, codes, codes << 6)


@dataclass
class FrameRange(InputPartition):
    """Frames ``start`` to ``stop`` (exclusive, counted from the start of the file) of one file."""

    clip: str
    path: str
    first: int
    start: int
    stop: int


@dataclass
class Wanted:
    """What pushed filters leave: clips (all if None) and the frame numbers from ``low`` to ``high``."""

    clips: set | None = None
    low: int = 0
    high: int = (1 << 31) - 1

    def take(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        if isinstance(f, IsNotNull) and column in (("clip_id",), ("frame_idx",)):
            return True
        if column == ("clip_id",) and isinstance(f, EqualTo | In):
            named = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.clips = named if self.clips is None else self.clips & named
            return True
        if column != ("frame_idx",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or not isinstance(f.value, int):
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        return True


def named(path: str) -> tuple[str, int]:
    """Clip and first frame by a file's name."""
    stem = NAME.fullmatch(posixpath.basename(path))
    return (files.plain(stem[1]), int(stem[2])) if stem[2] else (stem[1], 0)


class RawPlanesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.columns = schema.names
        self.root = options["path"]
        self.shape = Shape.of(options)
        self.per_task = int(options.get("framesPerTask", max(1, PART_BYTES // self.shape.frame_bytes)))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> Sequence[FrameRange]:
        out = []
        for info in files.listed(self.root):
            clip, first = named(info.path)
            count, rest = divmod(info.size, self.shape.frame_bytes)
            if rest:
                raise ValueError(f"clip {clip}: {rest} bytes after frame {first + count - 1} are no whole {self.shape.width}x{self.shape.height} frame")
            if self.wanted.clips is not None and clip not in self.wanted.clips:
                continue
            start, stop = max(0, self.wanted.low - first), min(count, self.wanted.high - first + 1)
            out += [FrameRange(clip, info.path, first, a, min(a + self.per_task, stop)) for a in range(start, stop, self.per_task)]
        return out or [FrameRange("", "", 0, 0, 0)]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        size = self.shape.frame_bytes if {"cb", "cr"} & set(self.columns) else 2 * self.shape.luma if "luma" in self.columns else 0
        step = max(1, BATCH_BYTES // self.shape.frame_bytes)
        system, _ = files.opened(self.root)
        source = system.open_input_file(part.path) if size and part.stop > part.start else None
        for a in range(part.start, part.stop, step):
            frames = range(a, min(a + step, part.stop))
            planes: dict[str, list[bytes]] = {"luma": [], "cb": [], "cr": []}
            if source is not None:
                for i in frames:
                    words = np.frombuffer(source.read_at(size, i * self.shape.frame_bytes), "<u2")
                    if 2 * len(words) != size:
                        raise ValueError(f"{part.path} ended within frame {part.first + i}")
                    for name, codes in zip(planes, self.shape.planes(words), strict=False):
                        planes[name].append(codes.astype("<u2").tobytes())
            n = len(frames)
            numbers = {"frame_idx": [part.first + i for i in frames], "width": [self.shape.width] * n, "height": [self.shape.height] * n}
            made = {"clip_id": lambda: pa.array([part.clip] * n, pa.string())} | {k: lambda v=v: pa.array(v, pa.int32()) for k, v in numbers.items()} | {k: lambda v=v: pa.array(v, pa.binary()) for k, v in planes.items()}
            yield pa.record_batch([made[c]() for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class RawPlanesWriter(DataSourceArrowWriter):
    """Files of consecutive frames. Rows come in the order of clip, segment and frame; a gap begins a new file."""

    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.root, self.shape = options["path"], Shape.of(options)
        self.per_file = int(options.get("framesPerFile", FRAMES_PER_FILE))
        files.cleared(self.root, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        pending = files.Pending(self.root)
        parts: list[dict] = []
        out, last = None, None
        for batch in iterator:
            for row in batch.to_pylist():
                clip, frame = row["clip_id"], row["frame_idx"]
                if last == (clip, frame):
                    raise ValueError(f"clip {clip} has frame {frame} twice")
                if out is None or last != (clip, frame - 1) or frame % self.per_file == 0:
                    if out is not None:
                        out.close()
                    at, out = pending.create()
                    parts.append({"at": at, "name": f"{files.safe(clip)}@{frame:09d}.yuv", "frames": 0})
                if (row["width"], row["height"]) != (self.shape.width, self.shape.height):
                    raise ValueError(f"clip {clip}: frame {frame} is {row['width']}x{row['height']}")
                out.write(self.shape.words(*(np.frombuffer(row[p], "<u2") for p in ("luma", "cb", "cr"))).astype("<u2").tobytes())
                parts[-1]["frames"] += 1
                last = (clip, frame)
        if out is not None:
            out.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        shape = {"width": self.shape.width, "height": self.shape.height, "layout": self.shape.layout, "holes": self.shape.holes}
        files.commit(self.root, [p for m in messages if m for p in m.parts], shape)

    def abort(self, messages: list[Written | None]) -> None:
        files.abort(self.root, [p for m in messages if m for p in m.parts])


class RawPlanes(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schemas.PLANES

    def reader(self, schema: StructType) -> RawPlanesReader:
        return RawPlanesReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RawPlanesWriter:
        return RawPlanesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it take filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RawPlanes)


def read_raw(spark: SparkSession, path: str, width: int, height: int, layout: str = "planar", columns: Sequence[str] | None = None, frames_per_task: int | None = None, holes: bool = False) -> DataFrame:
    """Planes of the raw files under ``path``; with ``columns`` only these are read."""
    register(spark)
    whole = StructType.fromDDL(schemas.PLANES)
    schema = whole if columns is None else StructType([whole[c] for c in columns])
    reader = spark.read.format(FORMAT).schema(schema).option("width", width).option("height", height).option("layout", layout).option("holes", holes)
    return (reader if frames_per_task is None else reader.option("framesPerTask", frames_per_task)).load(path)


def write_raw(planes: DataFrame, path: str, width: int, height: int, layout: str = "planar", frames_per_file: int = FRAMES_PER_FILE, holes: bool = False) -> None:
    """Planes as raw files of at most so many frames. A task holds a segment of a clip, never the clip."""
    register(planes.sparkSession)
    segment = F.floor(F.col("frame_idx") / frames_per_file)
    dealt = planes.select("clip_id", "frame_idx", "width", "height", "luma", "cb", "cr").repartition("clip_id", segment).sortWithinPartitions("clip_id", "frame_idx")
    writer = dealt.write.format(FORMAT).mode("overwrite").option("width", width).option("height", height).option("layout", layout).option("holes", holes)
    writer.option("framesPerFile", frames_per_file).save(path)
