"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may differ from a passage by e word edits. Cut into e + 1 pieces, at least one of them stands unedited in the passage.
Hashes of the pieces are looked up at every word of every text; each hit fixes a diagonal, around which Myers' bit-parallel
distance (a Python integer holds the m bits) finds the cheapest passage. The item matches if the
distance is at most e. Words are runs of letters and digits in lower case, so punctuation and line breaks don't count.

The items are held in blocks of at most ``BLOCK_CHARS`` characters and each block is compared with all texts, so what travels to
the executors is bounded however large the benchmark is. Texts are read whole; no hit is capped.

Defined results: null and empty texts and items without a word match nothing; items under ``EXACT_BELOW`` words must match exactly;
items with equal text all match; of equal distances the earliest passage is reported. Null item ids are kept as null.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .tasks import unused

BLOCK_CHARS = 16 << 20
EDIT_SHARE = 0.15
EXACT_BELOW = 8
HIT = "ARRAY<STRUCT<item_id: BIGINT, distance: INT, start: INT, stop: INT>>"


class Items(NamedTuple):
    ids: list[int | None]
    hashes: list[np.ndarray]  # per item its word hashes
    budgets: list[int]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # piece length → filter, hashes, item, offset


def budget(m: int) -> int:
    return 0 if m < EXACT_BELOW else max(1, int(m * EDIT_SHARE))


def pieces(m: int, e: int) -> list[tuple[int, int]]:
    """Offset and length of e + 1 pieces of m words."""
    cuts = [m * i // (e + 1) for i in range(e + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def prepare(ids: list[int | None], texts: list[str | None]) -> Items:
    found = W.words_of(pa.array([(t or "").lower() for t in texts], pa.string()), W.NON_WORD)
    hashes = [found.hashes[a:b] for a, b in zip(found.first, found.first[1:], strict=False)]
    budgets = [budget(len(h)) for h in hashes]
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for k, (h, e) in enumerate(zip(hashes, budgets, strict=True)):
        if len(h):
            for offset, length in pieces(len(h), e):
                rows.setdefault(length, []).append((int(W.grams(h[offset : offset + length], length)[0]), k, offset))
    tables = {}
    for length, entries in rows.items():
        entries.sort()
        keys = np.array([x[0] for x in entries], np.uint64)
        quick = np.zeros(1 << 20, bool)
        quick[keys >> np.uint64(44)] = True
        tables[length] = (quick, keys, np.array([x[1] for x in entries]), np.array([x[2] for x in entries]))
    return Items(list(ids), hashes, budgets, tables)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of the text, and the position after its first such end."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, x in enumerate(text.tolist()):
        eq = masks.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1  # the first row is zero: a passage may begin anywhere
        plus = full & (mh | ~(xv | ph))
        minus = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


def passage(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Distance, start and stop of the cheapest passage; the start by the same search backwards."""
    distance, end = myers(pattern, text)
    _, length = myers(pattern[::-1], text[:end][::-1])
    return distance, end - length, end


def hits(items: Items, texts: pa.Array) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for a, b in W.slices(texts):
        found = W.words_of(texts.slice(a, b - a), W.NON_WORD)
        rows = found.rows()
        seen: set[tuple[int, int, int]] = set()
        for length, (quick, keys, item, offset) in items.tables.items():
            g = W.grams(found.hashes, length)
            at = np.flatnonzero(quick[g >> np.uint64(44)])
            at = at[rows[at] == rows[at + length - 1]]
            low, high = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            for p, x, y in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                seen.update((int(rows[p]), int(item[q]), p - int(offset[q])) for q in range(x, y))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, k, diagonal in sorted(seen):
            e, m = items.budgets[k], len(items.hashes[k])
            low = max(int(found.first[row]), diagonal - e)
            high = min(int(found.first[row + 1]), diagonal + m + e)
            distance, start, stop = passage(items.hashes[k], found.hashes[low:high])
            if distance <= e:
                shift = low - int(found.first[row])
                best[row, k] = min(best.get((row, k), (m + 1, 0, 0)), (distance, start + shift, stop + shift))
        for (row, k), (distance, start, stop) in sorted(best.items()):
            out[a + row].append({"item_id": items.ids[k], "distance": distance, "start": start, "stop": stop})
    return out


def matcher(items: Items):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    def match(texts: pa.Array) -> pa.Array:
        return pa.array(hits(items, texts), kind)

    match.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(match, HIT).asNondeterministic()


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_CHARS) -> list[Items]:
    """The benchmark in blocks of bounded size: only one block at a time is fetched."""
    sized = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("t"), F.coalesce(F.length(text), F.lit(0)).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    n = int(total // most) + 1
    out = []
    for i in range(n):
        rows = (sized if n == 1 else sized.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i)).select("id", "t").collect()
        if rows:
            out.append(prepare([r[0] for r in rows], [r[1] for r in rows]))
    return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``leaks``: the matching items with distance and word span (start, stop), an empty array for a clean text."""
    kept = [c for c in docs.columns if c != "leaks"]
    found = [matcher(items)(F.lower(F.col(text))) for items in blocks(benchmark, item_id, item_text, block_chars)]
    if not found:
        return docs.select(*kept, F.array().cast(HIT).alias("leaks"))
    out, names = docs, []
    for column in found:
        names.append(unused(out.columns, "leaks_"))
        out = out.withColumn(names[-1], column)
    return out.select(*kept, F.concat(*names).alias("leaks"))
