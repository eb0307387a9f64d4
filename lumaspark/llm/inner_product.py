"""Exact top-k by inner product, with the MaxScore split of each query's components.

A query's terms are its components; the posting list of a dimension holds the component of every vector, in the order of the vectors. Each block of vectors
has a greatest and a least component per dimension, which bound what the dimension can add to a query. Per query and block the dimensions are sorted by bound. The smallest ones
that together stay below the tenth best score so far are non-essential: the essential lists are traversed for
the whole block, and the non-essential ones only probed, largest bound first, for vectors that are still competitive. A block whose bounds don't reach the tenth best is
skipped whole. Spark splits the vectors over the tasks; the best of all tasks are merged.

Vectors have a component everywhere, so unlike words the essential lists name every vector of the block; what is saved is the probing of the others.

Queries are taken in blocks of a stated number of values, with one pass over the vectors per block: neither the driver nor a task holds more than one block of queries and one of vectors.

Components become whole numbers (floor of a multiple of the value), and scores are exact 64-bit integers; a score that might not fit fails the job.

Defined results: a vector that is null or holds a null, infinite or undefined component takes no part; nor does a row without an id. A missing component of a shorter vector is zero;
so an empty vector scores 0 with all. Rows with a query's id are its own and are never its candidates. Rows of one id and different vectors are candidates of their own; as
query, the least of them in array order stands for the id. Equal scores rank by id. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranked_search import Best
from .tasks import discard, flat, stage

BEST = 10
SCALE = 1024
QUERY_VALUES = 1 << 22  # components of the queries of one pass
BLOCK_VALUES = 1 << 18  # components of the vectors looked at together
PROBED = 8  # lists probed before candidates are weeded out again
EXACT = float(1 << 53)
LEAST = -(1 << 63)
FOUND = "query_id LONG, vec_id LONG, score LONG"


class Queries(NamedTuple):
    ids: np.ndarray
    values: np.ndarray  # queries x dimensions


def whole(vector: Column) -> Column:
    """floor(scale * x) of each component, null unless all are finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.when(fine, F.transform(wide, lambda x: F.floor(F.lit(SCALE) * x).cast("long")))


def dense(lists: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of equal length, shorter ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.flatten().to_numpy()
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    at = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - at[row]] = values
    return out


class Block:
    """Vectors as posting lists: a row per dimension, with the greatest and least component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.high, self.low = vectors.max(axis=0), vectors.min(axis=0)
        self.most = np.maximum(np.abs(self.high.astype(float)), np.abs(self.low.astype(float)))
        self.lists = np.ascontiguousarray(vectors.T)
        self.quick = self.lists.astype(float)  # the same numbers, for products that a double holds exactly


def look(block: Block, query_id: int, query: np.ndarray, best: Best) -> None:
    """One query over one block. A dimension that either side lacks adds nothing."""
    width = min(len(query), len(block.lists))
    query = query[:width]
    size = float(np.abs(query.astype(float)) @ block.most[:width])
    if size >= float(1 << 62):
        raise OverflowError(f"scores of query {query_id} don't fit into 64 bits")
    lists = block.quick if size < EXACT else block.lists
    query = query.astype(lists.dtype)
    bounds = np.maximum(query * block.high[:width], query * block.low[:width])
    order = np.argsort(bounds, kind="stable")
    reach = np.concatenate([[0], np.cumsum(bounds[order])])  # reach[j]: of the j smallest together
    least = best.least
    if reach[-1] < least:
        return
    j = int(np.searchsorted(np.maximum.accumulate(reach[1:]), least, "left"))  # so many lists are non-essential
    essential = order[j:]
    sums = query[essential] @ lists[essential] if len(essential) else np.zeros(len(block.ids), lists.dtype)
    rows = np.flatnonzero(block.ids != query_id)
    sums = sums[rows]
    while j > 0:
        alive = sums + reach[j] >= least
        rows, sums = rows[alive], sums[alive]
        if not len(rows):
            return
        probed = order[max(j - PROBED, 0) : j]
        sums = sums + query[probed] @ lists[np.ix_(probed, rows)]
        j -= len(probed)
    best.add(sums.astype(np.int64), block.ids[rows])


def searcher(queries: Queries, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(size, LEAST) for _ in queries.ids]
        for batch in batches:
            longest = int(np.diff(batch.column("vector").offsets.to_numpy()).max(initial=1))
            step = max(1, BLOCK_VALUES // max(1, longest))  # rows are filled up to the longest
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                block = Block(flat(part, "id"), dense(part.column("vector")))
                for query_id, query, b in zip(queries.ids.tolist(), queries.values, best, strict=True):
                    look(block, query_id, query, b)
        found = [(i, b) for i, b in zip(queries.ids.tolist(), best, strict=True) if len(b.ids)]
        for a in range(0, len(found), 1000):
            part = found[a : a + 1000]
            yield pa.record_batch(
                [pa.array(np.repeat([i for i, _ in part], [len(b.ids) for _, b in part]), pa.int64()), pa.array(np.concatenate([b.ids for _, b in part])), pa.array(np.concatenate([b.scores for _, b in part]))],
                names=["query_id", "vec_id", "score"],
            )

    return run


def search(vectors: DataFrame, is_query: Column, size: int = BEST, vec_id: str = "vec_id", vector: str = "embedding", query_values: int = QUERY_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` with ``is_query`` the ``size`` other rows of greatest inner product."""
    spark = vectors.sparkSession
    numbers = vectors.select(F.col(vec_id).cast("long").alias("id"), is_query.alias("asks"), whole(F.col(vector)).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    asked = stage(numbers.where("asks").groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    candidates = numbers.select("id", "vector")
    n, longest = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_blocks = n * (1 + (longest or 0)) // query_values + 1
    found = None
    for i in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i).toArrow()
        if not rows.num_rows:
            continue
        queries = Queries(flat(rows, "id"), dense(rows.column("vector")))
        part = stage(candidates.mapInArrow(searcher(queries, size), FOUND), "found")
        found = part if found is None else found.union(part)
    discard(asked)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
