"""Near-duplicate join on word 5-gram sets with Bayesian candidate pruning.

1. Each text gets 96 MinHash values; texts that are equal are one node, known by its least id.
2. 32 bands of 3 values put nodes into buckets: a pair of Jaccard similarity 0.8 shares none with probability (1 - 0.8^3)^32 < 2e-10.
3. The pairs of a bucket are compared 16 values at a time. After n values with m equal the posterior probability (uniform prior) that the
   similarity reaches the threshold is P(Binomial(n + 1, threshold) <= m); below ``TOLERANCE`` the pair is dropped.
4. The rest is verified exactly on the 5-gram sets (as 64-bit hashes).

No pair becomes a row. A bucket of n nodes is dealt into about n / ``BLOCK`` blocks, or more if their n-grams pass ``BLOCK_BYTES`` each, and each pair of blocks is one group of bounded size; what leaves it is a list of
surviving pairs in one row, later one row per node with the number of its links and the least node it is connected to in the group. A pair is handled only in the
first band that it shares. Equal texts are collapsed by an aggregation, so a third of all rows being copies costs one node.

Defined results: a null text or id links to nothing and is its own class; equal texts are one class, also if they hold no word; different
texts without a word don't link; texts of under five words have one n-gram of all their words. Repeated rows count as copies. Rows of one id and different texts are one node.
Other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .tasks import binaries, components, flat, runs, stage

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BANDS, BAND_ROWS = 96, 32, 3
STEP = 16
VALUE = np.dtype(np.uint16)  # kept bits of a MinHash value, spread anew; different minima agree by chance once in 65536, which only keeps a pair
TOLERANCE = 1e-9
BLOCK = 256
BLOCK_BYTES = 32 << 20  # of n-gram hashes in a block
PAIRS_AT_ONCE = 1 << 15
SKETCH_BYTES = 1 << 20
COLUMNS = 4096  # n-grams per matrix product

_random = np.random.Generator(np.random.PCG64(96))
MULTIPLIERS = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _random.integers(0, 2**63, HASHES, dtype=np.uint64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n compared values → fewest equal ones with which a pair stays."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes row by row, with repeats, and row offsets; a shorter text is one n-gram."""
    found = W.words_of(texts)
    counts = np.diff(found.first)
    at, ends = W.gram_starts(found.first, size)
    g = W.grams(found.hashes, size)[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return g, ends
    own = np.array([W.grams(found.hashes[found.first[r] : found.first[r + 1]], int(counts[r]))[0] for r in short.tolist()], np.uint64)
    shifts = np.zeros(len(counts) + 1, np.int64)
    shifts[short + 1] = 1
    return np.insert(g, ends[short], own), ends + np.cumsum(shifts)


def signatures(texts: pa.Array) -> pa.Array:
    """Kept bits of the MinHash values, null without a word, and the number of n-grams."""
    out: list[bytes | None] = []
    sizes: list[int] = []
    for a, b in W.slices(texts, SKETCH_BYTES):
        g, at = shingles(texts.slice(a, b - a))
        full = np.flatnonzero(np.diff(at))
        low = np.empty((len(full), HASHES), VALUE)
        for j in range(HASHES if len(full) else 0):
            # the top bits of a minimum over many n-grams are nought, so they are mixed with the others before the cut
            low[:, j] = W.mix(np.minimum.reduceat((g ^ FLIPS[j]) * MULTIPLIERS[j], at[full])) >> np.uint64(64 - 8 * VALUE.itemsize)
        lines: list[bytes | None] = [None] * (b - a)
        for k, r in enumerate(full.tolist()):
            lines[r] = low[k].tobytes()
        out += lines
        sizes += np.diff(at).tolist()
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], ["sketch", "grams"])


def shingle_sets(texts: pa.Array) -> pa.Array:
    out: list[bytes] = []
    for a, b in W.slices(texts):
        g, at = shingles(texts.slice(a, b - a))
        out += [np.unique(g[x:y]).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.array(out, pa.binary())


def arrow(function, kind: str):
    function.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(function, kind).asNondeterministic()


def survivors(s: np.ndarray, i: np.ndarray, j: np.ndarray, band: int, need: dict[int, int]) -> np.ndarray:
    """Which of the pairs stay after the incremental comparison and have ``band`` as their first common one."""
    kept = np.arange(len(i))
    same = np.zeros(len(i), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        same = same + (s[i[kept], n - STEP : n] == s[j[kept], n - STEP : n]).sum(axis=1)
        ok = same >= need[n]
        kept, same = kept[ok], same[ok]
        if not len(kept):
            return kept
    equal = (s[i[kept]] == s[j[kept]]).reshape(-1, BANDS, BAND_ROWS).all(axis=2)
    return kept[equal.argmax(axis=1) == band]


def compare(need: dict[int, int]):
    """Rows (key, lo, hi, band, block, node, copies, sketch) sorted by group → one row per group with surviving pairs."""

    def task(batches):
        for rows, cuts in runs(batches, ("key", "lo", "hi")):
            raw, _ = binaries(rows.column("sketch"))
            s = raw.view(VALUE).reshape(-1, HASHES)
            key, lo, hi, band, block, node, copies = (flat(rows, c) for c in ("key", "lo", "hi", "band", "block", "node", "copies"))
            out: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                if lo[a] == hi[a]:
                    i, j = np.triu_indices(b - a, 1)
                else:
                    left = np.flatnonzero(block[a:b] == lo[a])
                    right = np.flatnonzero(block[a:b] == hi[a])
                    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                differ = node[a + i] != node[a + j]
                i, j = i[differ], j[differ]
                kept = [c + survivors(s[a:b], i[c : c + PAIRS_AT_ONCE], j[c : c + PAIRS_AT_ONCE], band[a], need) for c in range(0, len(i), PAIRS_AT_ONCE)]
                kept = np.concatenate(kept) if kept else np.zeros(0, int)
                if len(kept):
                    used, local = np.unique(np.concatenate([i[kept], j[kept]]), return_inverse=True)
                    out.append((key[a], lo[a], hi[a], node[a:b][used], copies[a:b][used], local.astype(np.int32).tobytes()))
            if out:
                columns = list(zip(*out, strict=True))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in columns[3]])))
                yield pa.record_batch(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                     W.columns(np.concatenate(columns[3]), offsets, pa.int64()), W.columns(np.concatenate(columns[4]), offsets, pa.int64()), pa.array(columns[5], pa.binary())],
                    ["key", "lo", "hi", "nodes", "copies", "pairs"],
                )

    return task


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(i) <= 8:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    size = np.diff(np.append(begin, len(values)))
    shared = np.repeat(size > 1, size)
    column = np.repeat(np.cumsum(size > 1) - 1, size)[shared]
    owner = owner[shared]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((size > 1).sum()), COLUMNS):
        x, y = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[x:y], column[x:y] - low] = 1
        total += held @ held.T
    return np.rint(total[i, j]).astype(np.int64)


def linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = list(range(n))
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(n):
        root[x] = root[root[x]]
    return np.array(root)


def verify(threshold: float):
    """Sorted rows of a group, first its pair list (place -1), then its nodes' n-gram sets → node, links, root."""

    def task(batches):
        for rows, cuts in runs(batches, ("key", "lo", "hi")):
            node, copies = flat(rows, "node"), flat(rows, "copies")
            raw, at = binaries(rows.column("value"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i, j = raw[at[a] : at[a + 1]].view(np.int32).reshape(2, -1)
                sets = [np.frombuffer(raw[at[k] : at[k + 1]].tobytes(), np.uint64) for k in range(a + 1, b)]
                size = np.array([len(x) for x in sets])
                both = overlaps(sets, i, j)
                ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
                if not ok.any():
                    continue
                i, j = i[ok], j[ok]
                ids, weight, m = node[a + 1 : b], copies[a + 1 : b], b - a - 1
                order = np.argsort(ids, kind="stable")
                place = np.empty(m, int)
                place[order] = np.arange(m)
                root = ids[order][linked(m, place[i], place[j])[place]]
                links = np.bincount(i, weight[j], m) + np.bincount(j, weight[i], m)
                hit = np.flatnonzero(links)
                out.append((ids[hit], links[hit].astype(np.int64), root[hit]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "links", "root"])

    return task


def placed(nodes: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes (node, sketch, grams) → key, band, node, block, lo, hi: a row for each pair of blocks of a bucket that a node is compared in."""
    width = VALUE.itemsize * BAND_ROWS
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sketch", b * width + 1, F.lit(width)))))
    banded = nodes.where("sketch IS NOT NULL").select("node", "grams", band.alias("band", "key"))
    full = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("grams").alias("n_grams")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("n_grams") * 8 / block_bytes)).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(11)), parts)
    dealt = banded.join(full, "key").select("key", "band", "node", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    return dealt.select("key", "band", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``rep_id`` (least id with that text), ``class_id`` (least id of the component of links),
    ``n_copies`` (rows with that text) and ``n_links`` (other rows of similarity ``threshold`` or more, copies among them)."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    text_key = F.when(F.col("doc_id").isNotNull(), F.unhex(F.md5(F.col("text").cast("binary"))))
    sketched = stage(given.select("doc_id", text_key.alias("key"), arrow(signatures, "STRUCT<sketch: BINARY, grams: BIGINT>")("text").alias("s")).select("doc_id", "key", "s.*"), "join-sketches")
    nodes = stage(
        sketched.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("grams").alias("grams")), "join-nodes"
    )
    compared = placed(nodes, block, block_bytes).join(nodes.select("node", "copies", "sketch"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = stage(
        compared.mapInArrow(compare(least_matches(threshold, tolerance)), "key BIGINT, lo BIGINT, hi BIGINT, nodes ARRAY<BIGINT>, copies ARRAY<BIGINT>, pairs BINARY"), "join-pairs"
    )
    members = pairs.select("key", "lo", "hi", F.posexplode(F.arrays_zip("nodes", "copies")).alias("place", "x")).select("key", "lo", "hi", "place", F.col("x.nodes").alias("node"), F.col("x.copies").alias("copies"))
    wanted = members.select("node").distinct()
    texts = given.join(wanted, given["doc_id"] == wanted["node"], "left_semi")
    sets = texts.where("text IS NOT NULL").select(F.col("doc_id").alias("node"), arrow(shingle_sets, "binary")("text").alias("value")).dropDuplicates(["node"])
    rows = members.join(sets, "node").select("key", "lo", "hi", "place", "node", "copies", "value")
    lists = pairs.select("key", "lo", "hi", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), F.col("pairs").alias("value"))
    links = stage(
        rows.unionByName(lists).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "place").mapInArrow(verify(threshold), "node BIGINT, links BIGINT, root BIGINT"), "join-links"
    )
    classes = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), "join-components")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("key", "node", "copies").join(counts, "node", "left").join(classes, "node", "left")
    return sketched.select("doc_id", "key").join(known, "key", "left").select(
        "doc_id", F.coalesce("node", "doc_id").alias("rep_id"), F.coalesce("component", "node", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose class has a lesser id; of repeated rows with one id a single one stays; rows without an id stay."""
    found = stage(join(docs, doc_id, text, **how).where("doc_id IS NOT NULL"), "join-classes")
    # the ids that go are fewer than those that stay; still they grow with the corpus, so they are merged and never broadcast
    gone = found.where("doc_id != class_id").select(F.col("doc_id").alias("_gone")).distinct().hint("merge")
    kept = docs.join(gone, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
    if found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(kept.where(F.col(doc_id).isNull()))
