"""Ranked lexical search: the best documents of each query, short lists by accumulators and long ones document at a time.

The documents are split as Spark splits them; each block of rows of a task is a small inverted index over the terms that
the queries ask for. Inside a block, the posting lists of a query that are short are worked off a term at a time into
summed accumulators. The accumulators, sorted by document, are then one more list with a bound, beside the long lists.
Over all these the documents are taken in order, window by window: lists whose bounds together stay below the tenth best score
so far give no candidates, and are only probed for candidates that can still get in. The best of all tasks are merged by Spark.

Weights and lengths are those of the whole table: a first pass reads every text once and keeps, for each document, its
length and the counts of asked terms (a row with two arrays, no row per term). Queries are taken in blocks of a stated number of terms, one
pass per block, so neither the driver nor a task ever holds more than one block of queries and one block of documents.

Scores are the integers of a saturated term frequency with length normalisation; see ``impacts``. A term is known by a 64-bit hash.

Defined results: a document without a term (null and empty texts too) counts nowhere and is never found. Rows without an id are left
out, documents and queries alike. Rows of one document id are documents of their own, and rank side by side; rows of one
query id are one query with the terms of all. A query without a term, or whose terms no document has, has no rows. Equal
scores rank by document id. Texts are read whole, a long one in pieces. Only the named columns are read, so no other can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .tasks import discard, flat, stage

BEST = 10
BLOCK_TERMS = 1 << 18  # query terms searched for in one pass
BLOCK_POSTINGS = 1 << 20  # postings of a task's inverted block
BLOCK_ROWS = 1 << 16
WINDOW_ROWS = 1 << 12  # documents taken together
SHORT_PART = 32  # a list is short if it holds no more than a row in so many
SATURATION, LENGTH_SHARE = 8, 90  # fixed values of the score
HELD = "doc_id LONG, n LONG, terms ARRAY<INT>, counts ARRAY<LONG>"
FOUND = "item_id LONG, doc_id LONG, score LONG"


class Corpus(NamedTuple):
    documents: int  # N: with a term at least
    terms: int  # L: of all documents, with repeats


class Queries(NamedTuple):
    ids: list[int]
    asked: list[np.ndarray]  # per query the numbers of its terms
    terms: np.ndarray  # sorted hashes


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the terms of some rows, and their rows; a long text comes in several pieces."""
    pieces, row = W.pieces(texts, W.NON_WORD)
    for a, b in W.slices(pieces):
        found = W.words_of(pieces.slice(a, b - a), W.NON_WORD, W.LOWER)
        yield found.hashes, row[a:b][found.rows()]


def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, term for each distinct term of each row."""
    for batch in batches:
        ids = flat(batch, "id")
        for hashes, rows in counted(batch.column("text")):
            if len(hashes):
                pairs = np.unique(np.stack([rows.astype(np.uint64), hashes], axis=1), axis=0)
                yield pa.record_batch([pa.array(ids[pairs[:, 0].astype(np.int64)], pa.int64()), pa.array(pairs[:, 1].view(np.int64))], names=["item_id", "term"])


def term_counter(wanted: np.ndarray):
    """Per document with a term: its length, and the number and count of each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for hashes, rows in counted(batch.column("text")):
                length += np.bincount(rows, minlength=batch.num_rows)
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                hit = wanted[at] == hashes
                key, n = np.unique(rows[hit] * len(wanted) + at[hit], return_counts=True)
                keys.append(key)
                counts.append(n)
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, place, np.concatenate(counts))
            kept = np.flatnonzero(length)
            at = np.searchsorted(key // len(wanted), np.append(kept, batch.num_rows))
            yield pa.record_batch(
                [pa.array(flat(batch, "id")[kept], pa.int64()), pa.array(length[kept]), W.columns((key % len(wanted)).astype(np.int32), at), W.columns(count, at)],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequencies], np.int64)


def impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What one term adds to one document, in whole numbers rounded down at each step."""
    if len(length) and LENGTH_SHARE * int(length.max()) * corpus.documents >= 1 << 63:
        part = np.array([LENGTH_SHARE * int(n) * corpus.documents // corpus.terms for n in length], np.int64)
    else:
        part = LENGTH_SHARE * length * corpus.documents // corpus.terms
    return weight * (1_000_000_000 * count // (1000 * count + SATURATION * (100 - LENGTH_SHARE + part)))


class Best:
    """The best scores of one query so far, from ``floor`` on, ties to the smaller id."""

    def __init__(self, size: int, floor: int = 1):
        self.size, self.floor, self.scores, self.ids = size, floor, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this can't get in."""
        return int(self.scores[-1]) if len(self.scores) == self.size else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        kept = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[kept]]), np.concatenate([self.ids, ids[kept]])
        order = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[order], ids[order]


class Postings(NamedTuple):
    rows: np.ndarray  # ascending
    scores: np.ndarray
    bound: int


def inverted(doc_terms: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> dict[int, Postings]:
    """The posting lists of a block, by the number of the term."""
    kept = np.flatnonzero(scores > 0)
    if not len(kept):
        return {}
    order = kept[np.argsort(doc_terms[kept], kind="stable")]
    terms, rows, scores = doc_terms[order], rows[order], scores[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    return {int(terms[a]): Postings(rows[a:b], scores[a:b], int(scores[a:b].max())) for a, b in zip(first, np.append(first[1:], len(terms)), strict=True)}


def accumulated(lists: list[Postings]) -> Postings:
    """Short lists, a term at a time, as one list of summed scores."""
    rows, scores = np.concatenate([x.rows for x in lists]), np.concatenate([x.scores for x in lists])
    order = np.argsort(rows, kind="stable")
    rows, scores = rows[order], scores[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    sums = np.add.reduceat(scores, first)
    return Postings(rows[first], sums, int(sums.max()))


def look(block: dict[int, Postings], asked: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """One query over one block."""
    lists = [block[t] for t in asked.tolist() if t in block]
    short = [x for x in lists if len(x.rows) * SHORT_PART <= len(ids)]
    its = [x for x in lists if len(x.rows) * SHORT_PART > len(ids)] + ([accumulated(short)] if short else [])
    its.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in its])  # what the lists up to this one can add together
    low = 0
    while low < len(ids) and its:
        essential = int(np.searchsorted(reach, best.least, "left"))  # lists before this one can't reach the best on their own
        if essential == len(its):
            return
        # The next document of an essential list; windows without one are skipped.
        starts = [int(np.searchsorted(x.rows, low)) for x in its[essential:]]
        nexts = [int(x.rows[p]) for x, p in zip(its[essential:], starts, strict=True) if p < len(x.rows)]
        if not nexts:
            return
        low = min(nexts)
        high = min(low + WINDOW_ROWS, len(ids))
        sums = np.zeros(high - low, np.int64)
        for x, a in zip(its[essential:], starts, strict=True):
            b = a + int(np.searchsorted(x.rows[a : a + WINDOW_ROWS], high))
            sums[x.rows[a:b] - low] += x.scores[a:b]
        rows = np.flatnonzero(sums)
        sums, rows = sums[rows], rows + low
        for j in range(essential - 1, -1, -1):
            alive = sums + reach[j] >= best.least
            rows, sums = rows[alive], sums[alive]
            if not len(rows):
                break
            at = np.minimum(np.searchsorted(its[j].rows, rows), len(its[j].rows) - 1)
            sums = sums + np.where(its[j].rows[at] == rows, its[j].scores[at], 0)
        best.add(sums, ids[rows])
        low = high


def searcher(queries: Queries, weight: np.ndarray, corpus: Corpus, size: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(size) for _ in queries.ids]
        for table in blocks(batches):
            lists = table.column("terms").combine_chunks()
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            terms, counts = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy()
            ids = flat(table, "doc_id")
            block = inverted(terms, rows, impacts(weight[terms], counts, flat(table, "n")[rows], corpus))
            for asked, b in zip(queries.asked, best, strict=True):
                look(block, asked, ids, b)
        found = [(i, b) for i, b in zip(queries.ids, best, strict=True) if len(b.ids)]
        for a in range(0, len(found), 1000):
            part = found[a : a + 1000]
            yield pa.record_batch(
                [pa.array(np.repeat([i for i, _ in part], [len(b.ids) for _, b in part]), pa.int64()), pa.array(np.concatenate([b.ids for _, b in part])), pa.array(np.concatenate([b.scores for _, b in part]))],
                names=["item_id", "doc_id", "score"],
            )

    return run


def query_block(asked: DataFrame, i: int, n: int) -> Queries:
    rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).select("item_id", "term").collect()
    terms = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64))
    of: dict[int, list[int]] = {}
    for item, term in rows:
        of.setdefault(item, []).append(term)
    ids = sorted(of)
    return Queries(ids, [np.searchsorted(terms, np.array(of[k], np.int64).view(np.uint64)) for k in ids], terms)


def search(
    docs: DataFrame, items: DataFrame, size: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``size`` best documents of each query."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL")
    named = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id IS NOT NULL")
    asked = stage(named.mapInArrow(distinct_terms, "item_id LONG, term LONG").distinct(), "asked")
    n_blocks = asked.count() // block_terms + 1
    found = None
    for i in range(n_blocks):
        queries = query_block(asked, i, n_blocks)
        if not queries.ids:
            continue
        held = stage(texts.mapInArrow(term_counter(queries.terms), HELD), "held")
        corpus = Corpus(*(int(v or 0) for v in held.agg(F.count("*"), F.sum("n")).first()))
        frequency = np.zeros(len(queries.terms), np.int64)
        for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            frequency[term] = n
        part = stage(held.mapInArrow(searcher(queries, weights(frequency, corpus.documents), corpus, size), FOUND), "found")
        discard(held)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
