"""Helpers of the operators: stage tables, sorted runs inside a task, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back, after which Spark drops the shuffle files of the
    write: what it wrote is read instead of them. ``discard`` removes the table."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/lumaspark-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged_at = path
    return read


def discard(*staged: DataFrame) -> None:
    """Removes staged tables that nothing will read again: all that was made from them is written itself."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, lengthened until it is none of the columns (whose names Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(columns: Sequence[str]) -> Column:
    """The given columns as one value, beside which an operator's own names can't clash. Without columns, a value of no meaning."""
    return F.struct(*columns) if columns else F.struct(F.lit(True).alias("none"))


def unpacked(column: str, columns: Sequence[str]) -> list[str]:
    return [f"{column}.*"] if columns else []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def flat(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy())


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables in which every run of equal keys is whole, with the borders of the runs. The input is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            same = all(held[-1].column(k)[held[-1].num_rows - 1].equals(batch.column(k)[batch.num_rows - 1]) for k in keys)
            if same:
                held.append(batch)
                continue
        joined = pa.Table.from_batches([*held, batch]).combine_chunks()
        cuts = borders(joined, keys)
        if len(cuts) > 2:
            yield joined.slice(0, int(cuts[-2])), cuts[:-1]
        rest = joined.slice(int(cuts[-2])).combine_chunks()
        held = rest.to_batches()
    if held:
        joined = pa.Table.from_batches(held).combine_chunks()
        yield joined, borders(joined, keys)


def borders(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a run begins, and the number of rows."""
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for k in keys:
        values = rows.column(k).combine_chunks()
        change[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return np.append(np.flatnonzero(change), rows.num_rows)


def binaries(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


HUB = 256  # rows of a node above which it may be a hub
MOST_HUBS = 100_000


def beside_least(rows: DataFrame, n_rows: int) -> DataFrame:
    """u, v, m: the rows (u, v) with the least ``v`` of their ``u``.

    A node with a large share of the rows would meet its rows in one task. Nodes with more than a certain number of rows, so few that there are at
    most ``MOST_HUBS`` of them whatever the graph, are broadcast to where their rows lie; all other rows are joined.
    """
    most = max(HUB, n_rows // MOST_HUBS)
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, component (the least node id in it) for the nodes of ``edges`` (u, v), by alternating large and small stars.

    Every round is written to the shared folder, and the one before it removed. A node's neighbours are never gathered; only their minimum is taken, and the rows of a
    hub stay spread. The driver sees one count and one checksum per round.
    """
    e = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
        mark = tuple(seen)
        both = stage(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), label)
        near = beside_least(both, 2 * seen[0]).withColumn("m", F.least("m", "u"))
        large = stage(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), label)
        low = beside_least(large, seen[0])
        small = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
        last, e = e, stage(small.select("s.*").where("u != v").distinct(), label)
        discard(last, both, large)
