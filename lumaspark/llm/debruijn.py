"""Removal of repeated passages by a compacted de Bruijn graph over words.

A window is ``WINDOW`` consecutive words of one document. Each window belongs to its minimiser, the least hash of its word 6-grams; the windows that
follow each other and share a minimiser are one edge of the graph (a run of k-mers without a branch), known by the minimiser's hash and the hash of all
words it covers. So about one row per seven words is shuffled, not one per word.

1. Only edges whose minimiser stands twice or more in the corpus can hold a repeated window; a semi-join keeps these.
2. Edges that occur more than once are linked to the edge that follows them at every occurrence, if that one is always preceded by them: these
   paths have no branch and are compacted by pointer doubling, one join per round. Every occurrence of a path but the first is a repeated span.
3. Where a minimiser has several different edges, the windows of each edge's first occurrence are compared one by one: passages begin and end inside edges.
4. A repeated span names the last place before it in its own document, else the first of all. Spans on one diagonal are joined, and each is verified at its source coordinates: both documents are read there and a 128-bit digest of the words must agree.
5. Words under a verified span are removed.

All groupings have map-side combination and all joins have one row per key on one side, so a passage or a copied document that makes up a third of the corpus is
split by Spark's skew handling. No document's passages meet in one task except with that document itself.

Defined results: a null or empty text has no words; documents under ``WINDOW`` words lose none; a null id takes no part. Rows of one id stand at the same place: they are not
each other's repeat, and where their texts differ nothing is removed from them on the strength of one another's words. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import words as W
from .tasks import discard, flat, stage

WINDOW = 20
ANCHOR = 6
EDGE = "anchor BIGINT, edge BIGINT, doc BIGINT, start INT, n INT"


def span_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * W.powers(W.GRAM_BASE, len(hashes)), out=sums[1:])
    inverse = W.powers(W.inverse(W.GRAM_BASE), len(hashes) + 1)
    return W.mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64))


def edges(window: int, anchor: int):
    """(doc, text) → one row per run of windows with one minimiser."""
    inside = window - anchor + 1

    def task(batches):
        for batch in batches:
            texts, docs = batch.column(1), flat(batch, "doc")
            for a, b in W.slices(texts):
                found = W.words_of(texts.slice(a, b - a))
                at, _ = W.gram_starts(found.first, window)
                if not len(at):
                    continue
                g = W.grams(found.hashes, anchor)
                least = at + np.lib.stride_tricks.sliding_window_view(g, inside).argmin(axis=1)[at]
                new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))))
                n = np.diff(np.append(new, len(at)))
                start = at[new]
                row = np.searchsorted(found.first, start, "right") - 1
                yield pa.record_batch(
                    [pa.array(g[least[new]].view(np.int64)), pa.array(span_hashes(found.hashes, start, n + window - 1).view(np.int64)), pa.array(docs[a:b][row]),
                     pa.array((start - found.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["anchor", "edge", "doc", "start", "n"],
                )

    return task


def lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a list of structs; a null list is empty."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    return offsets, {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}


def single_windows(window: int):
    """(doc, text, spans) → the hash of each window that starts in a span."""

    def task(batches):
        for batch in batches:
            texts, docs, (at, x) = batch.column(1), flat(batch, "doc"), lists(batch.column(2))
            for a, b in W.slices(texts):
                found = W.words_of(texts.slice(a, b - a))
                low, high = at[a], at[b]
                row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                n = x["n"][low:high].astype(np.int64)
                ok = x["start"][low:high] + n + window - 1 <= np.diff(found.first)[row]  # else another row of this id
                row, n, begin = row[ok], n[ok], x["start"][low:high].astype(np.int64)[ok]
                if not len(row):
                    continue
                ends = np.cumsum(n)
                start = np.repeat(begin - ends + n, n) + np.arange(ends[-1])
                owner = np.repeat(row, n)
                g = W.grams(found.hashes, window)
                yield pa.record_batch([pa.array(g[found.first[owner] + start].view(np.int64)), pa.array(docs[a:b][owner]), pa.array(start.astype(np.int32))], ["edge", "doc", "start"])

    return task


def digests(batches):
    """(doc, text, spans) → span, side and a digest of the words there (null where the text is shorter)."""
    for batch in batches:
        texts, (at, x) = batch.column(1), lists(batch.column(2))
        for a, b in W.slices(texts):
            found = W.words_of(texts.slice(a, b - a))
            out = []
            for r in range(a, b):
                base, count = int(found.first[r - a]), int(found.first[r - a + 1] - found.first[r - a])
                for k in range(at[r], at[r + 1]):
                    i, n = int(x["start"][k]), int(x["words"][k])
                    raw = found.data[found.starts[base + i] : found.ends[base + i + n - 1]].tobytes() if i + n <= count else None
                    out.append((x["span"][k], x["side"][k], raw and hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()))
            if out:
                span, side, digest = zip(*out, strict=True)
                yield pa.record_batch([pa.array(span, pa.int64()), pa.array(side, pa.int32()), pa.array(digest, pa.binary())], ["span", "side", "digest"])


def removals(spans: pa.Array, texts: pa.Array) -> list[tuple[int, int, bytes]]:
    """Words, removed words and the kept text of each row; ``spans`` lists struct(start, words)."""
    at, x = lists(spans)
    out = []
    for r, text in enumerate(texts):
        words = (text.as_py() or "").encode().split()
        n, low, high = len(words), at[r], at[r + 1]
        if high > low and spans[r].is_valid:
            change = np.zeros(n + 1, int)
            np.add.at(change, np.minimum(x["start"][low:high], n), 1)
            np.add.at(change, np.minimum(x["start"][low:high] + x["words"][low:high], n), -1)
            keep = np.cumsum(change[:n]) == 0
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        out.append((n, n - len(words), b" ".join(words)))
    return out


def cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = removals(spans, texts)
    return pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], ["n_words", "n_removed", "kept"]
    )


cleaned.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}


def paths(occurrences: DataFrame, repeated: DataFrame) -> DataFrame:
    """head, windows: the edges of ``repeated`` (edge, c) that begin a branchless path, with the windows of the whole path."""
    following = Window.partitionBy("doc").orderBy("start")
    seen = occurrences.join(repeated, "edge").select("edge", "c", "n", F.lead("edge").over(following).alias("next"), F.lead("start").over(following).alias("at"), "start")
    seen = seen.withColumn("next", F.when(F.col("at") == F.col("start") + F.col("n"), F.col("next")))
    steps = stage(seen.groupBy("edge", "next").agg(F.count("*").alias("times"), F.first("c").alias("c"), F.first("n").alias("n")), "debruijn-steps")
    sure = steps.where("next IS NOT NULL AND times = c AND next != edge").select("edge", "next", "c")
    counts = steps.groupBy("edge").agg(F.first("c").alias("next_c"))
    links = sure.join(counts.withColumnRenamed("edge", "next"), "next").where("c = next_c").select("edge", "next")
    sizes = steps.groupBy("edge").agg(F.first("n").cast("long").alias("windows"))
    jumps = stage(sizes.join(links, "edge", "left"), "debruijn-jumps")
    heads = stage(sizes.select("edge").join(links.select(F.col("next").alias("edge")), "edge", "left_anti"), "debruijn-heads")
    while not jumps.where("next IS NOT NULL").isEmpty():
        far = jumps.select(F.col("edge").alias("next"), F.col("next").alias("after"), F.col("windows").alias("more"))
        jumps = stage(
            jumps.join(far, "next", "left").select("edge", (F.col("windows") + F.coalesce("more", F.lit(0))).alias("windows"), F.col("after").alias("next")), "debruijn-jumps"
        )
    return jumps.join(heads, "edge").select("edge", "windows")


def sourced(occurrences: DataFrame, windows: Column) -> DataFrame:
    """All occurrences but the first, each with an earlier one: the last before it in its document, else the first of all."""
    later = occurrences.where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    own = F.col("prior").isNotNull()
    return later.select(
        "doc", F.col("start").cast("long"), windows.alias("windows"), F.when(own, F.col("doc")).otherwise(F.col("first.doc")).alias("source_doc"),
        F.coalesce("prior", "first.start").cast("long").alias("source_start"),
    )


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, start, words, source_doc, source_start: verified passages of which every window starts earlier, at the source."""
    given = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    # the place before in the same document: there a text that repeats itself has one source at one distance, and so one long span
    within = Window.partitionBy("doc", "edge").orderBy("start")
    all_edges = stage(given.mapInArrow(edges(window, anchor), EDGE), "debruijn-edges")
    twice = all_edges.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1")
    shared = stage(all_edges.join(twice, "anchor", "left_semi").withColumn("prior", F.lag("start").over(within)), "debruijn-shared")
    discard(all_edges)
    kinds = stage(shared.groupBy("anchor", "edge").agg(F.min(F.struct("doc", "start")).alias("first"), F.first("n").alias("n"), F.count("*").alias("c")), "debruijn-kinds")

    repeated = kinds.where("c > 1").select("edge", "c")
    heads = paths(shared.select("edge", "doc", "start", "n"), repeated)
    whole = heads.join(kinds.where("c > 1").select("edge", "first"), "edge")
    by_path = sourced(shared.select("edge", "doc", "start", "prior").join(whole, "edge"), F.col("windows"))

    branching = kinds.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1")
    firsts = kinds.join(branching, "anchor", "left_semi").select("first.doc", "first.start", "n")
    per_doc = firsts.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # no more than a document's own edges
    single = stage(given.join(per_doc, "doc").select("doc", "text", "spans").mapInArrow(single_windows(window), "edge BIGINT, doc BIGINT, start INT").withColumn("prior", F.lag("start").over(within)), "debruijn-windows")
    least = single.groupBy("edge").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    by_window = sourced(single.join(least, "edge"), F.lit(1).cast("long"))

    diagonal = Window.partitionBy("doc", "source_doc", "shift").orderBy("start", "windows")
    spans = by_path.unionByName(by_window).withColumn("shift", F.col("start") - F.col("source_start"))
    spans = spans.withColumn("reach", F.max(F.col("start") + F.col("windows")).over(diagonal.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    joined = spans.groupBy("doc", "source_doc", "shift", "part").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("windows")) - F.min("start") + window - 1).alias("words"))
    spans = stage(
        joined.select(F.xxhash64("doc", "source_doc", "shift", "part").alias("span"), "doc", "start", "words", "source_doc", (F.col("start") - F.col("shift")).alias("source_start")), "debruijn-spans"
    )
    return verified(given, spans)


def verified(given: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are the same at their source."""
    ends = spans.select("span", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("doc"), F.col("start")), F.struct(F.lit(1).alias("side"), F.col("source_doc").alias("doc"), F.col("source_start").alias("start")),
    )).alias("x"), "words")
    # one source may serve very many copies: its distinct places are read once
    places = ends.select(F.col("x.doc").alias("doc"), F.col("x.start").alias("start"), "words").distinct().withColumn("span", F.xxhash64("doc", "start", "words")).withColumn("side", F.lit(0))
    per_doc = places.groupBy("doc").agg(F.collect_set(F.struct("span", "side", "start", "words")).alias("spans"))
    read = given.join(per_doc, "doc").select("doc", "text", "spans").mapInArrow(digests, "span BIGINT, side INT, digest BINARY")
    sure = stage(read.groupBy("span").agg(F.min("digest").alias("digest"), F.count_distinct("digest").alias("kinds"), F.max(F.col("digest").isNull()).alias("short")).where("kinds = 1 AND NOT short").select("span", "digest"), "debruijn-digests")
    here = spans.withColumn("own", F.xxhash64("doc", "start", "words")).withColumn("there", F.xxhash64("source_doc", "source_start", "words"))
    both = here.join(sure.select(F.col("span").alias("own"), F.col("digest").alias("a")), "own").join(sure.select(F.col("span").alias("there"), F.col("digest").alias("b")), "there")
    return both.where("a = b").select("doc", "start", "words", "source_doc", "source_start")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by one space."""
    found = repeats(docs, doc_id, text, window, anchor)
    per_doc = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "words")).alias("_spans"))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    both = given.join(per_doc, F.col("doc_id") == F.col("_doc"), "left")
    result = F.arrow_udf(cleaned, "STRUCT<n_words: BIGINT, n_removed: BIGINT, kept: STRING>").asNondeterministic()
    return both.select("doc_id", result("_text", "_spans").alias("r")).select("doc_id", "r.*")
