"""Spelling variants of words by PartEnum signatures.

A word is the binary vector of its letter multiset: one dimension for the first, second, third … occurrence of each
letter. A replaced character moves a word by a Hamming distance of two, an inserted or deleted one by one. The dimensions are
partitioned, balanced by their counts in the vocabulary. Two vectors that differ in at most k dimensions agree on all but
k of n partitions, so every choice of n - k partitions is a signature: words of equal length share one of C(5, 3) signatures
if near, words of lengths L and L + 1 one of C(4, 3). The length is part of each signature.
Signatures are joined on equality and each candidate pair is verified by its edit distance.

A signature shared by more than ``LARGE`` words would verify all pairs among them. Those words are joined on the signature and one half of
the word instead: a single edit leaves the first or the last half as it was, so nothing is lost. All other joins are on words.

Defined results: null and empty texts have no words; no word, no row. A text without an id counts as it stands (nothing is deleted from its runs).
Rows of one id count as often as they stand there. Equal counts among near words go to the word first in code point order. Texts are read whole,
whatever their length; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .tasks import discard, stage

LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 7, 2, 10
NOISE = 31  # one run in so many loses a character
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # shorter runs give no word
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}
RUNS_AT_ONCE = 1 << 16
FLUSH = 1 << 18  # distinct words counted in a task before they are handed on
EQUAL, NEXT = (5, 2), (4, 1)  # partitions and differing ones, for words of one length and of lengths one apart
LARGE = 64
MOST_DIMENSIONS = 4096  # dimensions dealt out by count; rarer ones by hash
SIGNED = "key LONG, role TINYINT, size INT, word STRING, n LONG"


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(FOLD)


def observed(doc_id: int | None, run: str) -> str:
    """The run, without one character where the check sum of document and run says so."""
    if doc_id is None:
        return run
    h = crc32(f"{doc_id}:{run}".encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            matches = RUN.finditer(text.as_py() or "")
            while seen := Counter(m[0] for m in islice(matches, RUNS_AT_ONCE)):
                for run, n in seen.items():
                    word = observed(doc_id, lowered(run))
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
                if len(total) >= FLUSH:
                    yield out()
                    total.clear()
    if total:
        yield out()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of the texts that occur often enough."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    counted = texts.mapInArrow(word_counter, "word STRING, n LONG")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def dimensions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions set by each word, and their rows: code point and number of the occurrence within the word."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((points, rows))
    points, rows = points[order], rows[order]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(points)) - np.repeat(first, np.diff(np.append(first, len(points))))
    return (points << np.uint64(32)) + nth.astype(np.uint64), rows


def dimension_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found, counts = np.unique(dimensions(batch.column("word").to_pylist())[0], return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(counts)], names=["dimension", "n"])


def deal(known: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """The partition of each dimension: known ones (by falling count) dealt to and fro, others by hash."""
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], found), max(len(known) - 1, 0))
    rank = order[at] if len(known) else np.zeros(len(found), np.int64)
    turn = rank % (2 * n)
    dealt = np.where(turn < n, turn, 2 * n - 1 - turn)
    is_known = known[rank] == found if len(known) else np.zeros(len(found), bool)
    return np.where(is_known, dealt, (W.mix(found) % np.uint64(n)).astype(np.int64))


def signer(known: np.ndarray):
    """Signatures of words. Role 0 meets its like, role 1 (the shorter) meets role 2; ``size`` is the length of the shorter word of a pair."""

    def signatures(words: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        size = np.array([len(w) for w in words], np.int64)
        found, rows = dimensions(words)
        mixed = W.mix(found + np.uint64(1))
        for kind, (n, k) in enumerate((EQUAL, NEXT)):
            sums = np.zeros((len(words), n), np.uint64)
            np.add.at(sums, (rows, deal(known, found, n)), mixed)
            for role, shorter in ((0, size),) if kind == 0 else ((1, size), (2, size - 1)):
                for chosen in combinations(range(n), n - k):
                    key = shorter.astype(np.uint64) * np.uint64(2) + np.uint64(kind)
                    for p in chosen:
                        key = W.mix(key * np.uint64(W.GRAM_BASE) + sums[:, p] + np.uint64(p + 1))
                    yield key.view(np.int64), role, shorter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, role, size in signatures(batch.column("word").to_pylist()):
                yield pa.record_batch([pa.array(key), pa.array(np.full(len(key), role, np.int8)), pa.array(size.astype(np.int32)), batch.column("word"), batch.column("n")], names=["key", "role", "size", "word", "n"])

    return run


def halves(size: Column, word: Column) -> Column:
    """The half before the middle of the shorter word of a pair, and the rest, counted from the end."""
    h = F.floor(size / 2).cast("int")
    return F.array(F.concat(F.lit("<"), F.substring(word, F.lit(1), h)), F.concat(F.lit(">"), F.substring(word, F.length(word) - size + h + 1, size - h)))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, near, near_n for each two words of ``vocab`` (word, n) that one edit apart, both ways round."""
    counts = vocab.mapInArrow(dimension_counter, "dimension LONG, n LONG").groupBy("dimension").agg(F.sum("n").alias("n"))
    known = np.array([r[0] for r in counts.orderBy(F.col("n").desc(), "dimension").limit(MOST_DIMENSIONS).collect()], np.int64).view(np.uint64)
    signed = stage(vocab.mapInArrow(signer(known), SIGNED), "signatures")
    large = signed.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > LARGE).select("key", F.lit(True).alias("large"))
    dealt = signed.join(large, "key", "left").withColumn("half", F.explode(F.when(F.col("large"), halves(F.col("size"), F.col("word"))).otherwise(F.array(F.lit("")))))
    keyed = stage(dealt.select(F.when(F.col("large"), F.xxhash64("key", "half")).otherwise(F.col("key")).alias("key"), "role", "word", "n"), "keys")
    discard(signed)
    a, b = (keyed.select("key", "role", F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    one_edit = F.levenshtein("word_a", "word_b", 1) == 1
    equal = a.where("role = 0").join(b.where("role = 0"), "key").where((F.col("word_a") < F.col("word_b")) & one_edit)
    following = a.where("role = 1").join(b.where("role = 2"), "key").where(one_edit)
    pairs = equal.select("word_a", "word_b", "n_a", "n_b").union(following.select("word_a", "word_b", "n_a", "n_b")).distinct()
    both = F.explode(F.array(F.struct(F.col("word_a").alias("word"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("word_b").alias("word"), F.col("word_a").alias("near"), F.col("n_a").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root: ``forms`` (word, form) followed to the end, the reach doubled in each round."""
    reached = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = stage(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return reached


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts."""
    vocab = stage(vocabulary(docs, doc_id, text), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best)
    wins = -F.col("best.minus") >= DOMINANCE * F.col("n")
    judged = stage(
        vocab.join(near, "word", "left").select(
            "word", F.when(wins, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, -F.col("best.minus")).cast("long").alias("form_n")
        ),
        "judged",
    )
    most = judged.agg(F.max("n")).first()[0] or 1
    forms = judged.where("form IS NOT NULL").select("word", "form")
    # Each step at least multiplies the count, so a path is no longer than the digits of the largest one.
    found = judged.join(roots(forms, len(str(most))), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
