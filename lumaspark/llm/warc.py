"""WARC archives: writing, normalising whole-file gzip streams, and reading by a sidecar offset index.

A crawl archive that was compressed as one gzip stream can't be read from the middle. The normaliser inflates such a stream once, front to back
with bounded memory, rewrites each record as a gzip member of its own and writes a sidecar with one line per record: offset, length, record id and type. After that, any
range of records can be read by any task, so a large archive no longer binds one.

Archives are written and rewritten by tasks under names of their own, moved into place when complete; only the paths that a successful task returned are read on, so
retries and lost executors leave at most unread files. The folder lies in the shared folder of ``spark.checkpoint.dir`` and is opened by its URI.

Payloads are compared by SHA-1 and length. Among equal payloads of at least ``least_bytes`` the record with the least id is the response and the others are revisits without
a payload; smaller ones are all responses.

Defined results: a null payload is empty; a null url is written as an empty one; records of one id and equal payload are all responses; a null id is never the least one
(records that have only null ids and one payload are responses). A broken or truncated stream, or a digest that disagrees, fails the job. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import stage_dir
from .tasks import flat, stage

ARCHIVE_BYTES = 64 << 20  # of records before compression, after which a task begins another archive
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 18
LEVEL = 6
GZIP = 31  # zlib's window bits for a gzip member
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "archive STRING, records BIGINT"
NORMAL = "archive STRING, sidecar STRING, records BIGINT"
INDEX = "archive STRING, at BIGINT, length BIGINT, record_id STRING, kind STRING"
RECORD = "id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One uncompressed record; a revisit if ``first`` names another page."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page)}", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name_of(first)}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class Inflated:
    """The uncompressed bytes of a gzip file of one member or several, read front to back."""

    def __init__(self, handle):
        self.handle, self.held, self.stream, self.pending = handle, b"", None, b""

    def fill(self) -> bool:
        """Adds some bytes; False at the end of the file. Inflates at most ``READ_BYTES`` at a time."""
        while True:
            if not self.pending:
                self.pending = self.handle.read(READ_BYTES)
            if not self.pending:
                if self.stream is not None:
                    raise ValueError("the gzip stream ends early")
                return False
            self.stream = self.stream or zlib.decompressobj(GZIP)
            out = self.stream.decompress(self.pending, READ_BYTES)
            self.pending = self.stream.unconsumed_tail
            if self.stream.eof:
                self.pending, self.stream = self.stream.unused_data, None
            if out:
                self.held += out
                return True

    def head(self) -> bytes | None:
        """Bytes up to the next empty line, however many; None at the end of the archive."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self.fill():
                if self.held.strip():
                    raise ValueError("the archive ends within a record header")
                return None
        out, self.held = self.held[: at + 4], self.held[at + 4 :]
        return out

    def parts(self, n: int) -> Iterator[bytes]:
        """The next n bytes in parts."""
        while n:
            if not self.held and not self.fill():
                raise ValueError("the archive ends within a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Output:
    """A file that takes its name when it is complete."""

    def __init__(self, path: str):
        self.system, self.path = opened(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.handle, self.size = self.system.open_output_stream(self.path + ".part"), 0

    def write(self, data: bytes) -> None:
        self.handle.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.handle.close()
        self.system.move(self.path + ".part", self.path)


def write_streams(folder: str, archive_bytes: int, level: int):
    """(id, url, payload, first) → whole-file gzip archives."""

    def task(batches):
        out, path, packer, records, raw = None, "", None, 0, 0

        def finished():
            out.write(packer.flush())
            out.close()
            return pa.record_batch([pa.array([path]), pa.array([records], pa.int64())], ["archive", "records"])

        for batch in batches:
            ids, first = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for k in range(batch.num_rows):
                if out is None:
                    path = f"{folder}/whole/{uuid.uuid4().hex}.warc.gz"
                    out, packer, records, raw = Output(path), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                data = record(ids[k], batch.column(1)[k].as_py(), batch.column(2)[k].as_py() or b"", first[k])
                out.write(packer.compress(data))
                records, raw = records + 1, raw + len(data)
                if raw >= archive_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return task


def normalise_stream(source: str, target: str, level: int = LEVEL) -> int:
    """Rewrites one archive, each record a member of its own, and writes ``target``.idx; the number of records."""
    system, path = opened(source)
    out, index, count = Output(target), Output(target + ".idx"), 0
    with system.open_input_stream(path, compression=None) as handle:
        inflated = Inflated(handle)
        while (head := inflated.head()) is not None:
            fields = headers(head)
            packer, begin = zlib.compressobj(level, zlib.DEFLATED, GZIP), out.size
            out.write(packer.compress(head))
            for part in inflated.parts(int(fields["content-length"])):
                out.write(packer.compress(part))
            if b"".join(inflated.parts(4)) != b"\r\n\r\n":
                raise ValueError("a record is longer than it says")
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            index.write(f"{begin}\t{out.size - begin}\t{fields.get('warc-record-id', '')}\t{fields.get('warc-type', '')}\n".encode())
            count += 1
    out.close()
    index.close()
    return count


def rewrite(folder: str, level: int):
    def task(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/records/{uuid.uuid4().hex}.warc.gz"
                count = normalise_stream(source, target, level)
                yield pa.record_batch([pa.array([target]), pa.array([target + ".idx"]), pa.array([count], pa.int64())], ["archive", "sidecar", "records"])

    return task


def read_sidecars(batches):
    for batch in batches:
        for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, path = opened(sidecar)
            with system.open_input_stream(path) as handle:
                lines = [line.split("\t") for line in handle.read().decode().splitlines()]
            if lines:
                at, length, name, kind = zip(*lines, strict=True)
                yield pa.record_batch(
                    [pa.array([archive] * len(lines)), pa.array(list(map(int, at)), pa.int64()), pa.array(list(map(int, length)), pa.int64()), pa.array(name), pa.array(kind)],
                    ["archive", "at", "length", "record_id", "kind"],
                )


def parsed(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Id, payload bytes, digest, type and referred id of a record; a response's payload is measured anew."""
    data = zlib.decompress(member, GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    page, kind = page_of(fields["warc-record-id"]), fields["warc-type"]
    if kind == "revisit":
        length = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
        return page, int(length[1]), said, kind, page_of(fields["warc-refers-to"])
    if digest(payload) != said:
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
    return page, len(payload), said, kind, None


def read_members(batches):
    """Index rows, sorted by archive and offset → records."""
    system = path = handle = None
    for batch in batches:
        names, at, length = batch.column(0).to_pylist(), flat(batch, "at"), flat(batch, "length")
        rows = []
        for k, name in enumerate(names):
            if name != path:
                if handle is not None:
                    handle.close()
                system, inner = opened(name)
                path, handle = name, system.open_input_file(inner)
            handle.seek(int(at[k]))
            rows.append(parsed(handle.read(int(length[k]))))
        if rows:
            page, size, sha, kind, refers = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(sha), pa.array(kind), pa.array(refers, pa.int64())], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if handle is not None:
        handle.close()


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes whole-file gzip archives; their paths and record counts."""
    spark = pages.sparkSession
    folder = f"{stage_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    given = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    summed = given.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("bytes"))
    groups = summed.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # only the ids of revisits are joined to the pages, so a payload is moved at most once
    revisits = summed.join(groups, ["sha", "bytes"]).where("id IS NULL OR id != first").where("first IS NOT NULL").select("id", "sha", "bytes", "first").distinct()
    planned = given.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload")).join(
        revisits.withColumnRenamed("id", "_id").withColumnRenamed("sha", "_sha").withColumnRenamed("bytes", "_bytes"),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")) & (F.col("bytes") == F.col("_bytes")), "left",
    )
    return stage(planned.select("id", "url", "payload", "first").mapInArrow(write_streams(folder, archive_bytes, level), ARCHIVE), "warc-archives")


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """Rewrites each archive beside it in the shared folder; archive, sidecar and record count."""
    spark = archives.sparkSession
    folder = f"{stage_dir(spark)}/warc-{uuid.uuid4().hex}"
    # few rows, each much work: one archive per task as far as there are slots
    spread = archives.select("archive").repartition(spark.sparkContext.defaultParallelism, "archive")
    return stage(spread.mapInArrow(rewrite(folder, level), NORMAL), "warc-normal")


def index(normal: DataFrame) -> DataFrame:
    return normal.select("archive", "sidecar").mapInArrow(read_sidecars, INDEX)


def read(entries: DataFrame) -> DataFrame:
    """Records of index rows. A revisit's payload is that of the response that it refers to, which is checked."""
    ranged = entries.repartition(F.col("archive"), F.floor(F.col("at") / RANGE_BYTES)).sortWithinPartitions("archive", "at")
    records = stage(ranged.select("archive", "at", "length").mapInArrow(read_members, RECORD), "warc-records")
    responses = records.where("record_type = 'response'").groupBy("id", "payload_digest").agg(F.min("payload_bytes").alias("_bytes"))
    responses = responses.select(F.col("id").alias("_first"), F.col("payload_digest").alias("_digest"), "_bytes")
    joined = records.join(responses, (F.col("refers_to") == F.col("_first")) & (F.col("payload_digest") == F.col("_digest")), "left")
    lost = (F.col("record_type") == "revisit") & (F.col("_bytes").isNull() | (F.col("_bytes") != F.col("payload_bytes")))
    checked = F.when(lost, F.raise_error(F.concat(F.lit("a revisit has no response with its payload: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))).otherwise(F.col("payload_bytes"))
    return joined.select("id", checked.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
