"""Words of UTF-8 texts as arrays, for the operators that run numpy inside tasks.

A word is a maximal run of bytes that are no separators. Words and word n-grams are known by 64-bit
polynomial hashes, taken with a fixed random value per byte, so they are equal on every executor and
in every run. Everything works on an Arrow string array at once; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NON_WORD = np.ones(256, dtype=bool)  # everything but ASCII letters, digits and bytes of longer characters
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    NON_WORD[_a:_b] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
GRAM_BASE = 0xD6E8FEB86659FD93
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HASH_PIECE = 1 << 20  # bytes hashed at once
SLICE_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all rows
    starts: np.ndarray  # byte position of each word
    ends: np.ndarray
    first: np.ndarray  # index of each row's first word, one more entry than rows
    hashes: np.ndarray  # uint64 per word

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + HASH_PIECE, side="right")))
        n = int(ends[b - 1] - low)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[low : low + n]] * powers(BASE, n), out=sums[1:])
        at = starts[a:b] - low
        out[a:b] = mix((sums[ends[a:b] - low] - sums[at]) * powers(inverse(BASE), n)[at])
        a = b
    return out


def words_of(texts: pa.Array, separators: np.ndarray = WHITE, fold: np.ndarray | None = None) -> Words:
    """``fold`` maps each byte before words are hashed, such as ``LOWER``."""
    data, at = buffers(texts)
    data = data if fold is None else fold[data]
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at), word_hashes(data, starts, ends))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, over row borders too; see ``gram_rows``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k == 1:
        return mix(hashes)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(GRAM_BASE, len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * powers(inverse(GRAM_BASE), n))


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from which k words lie in one row, and the index of each row's first such position."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    at = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], counts), at


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text stands alone."""
    _, at = buffers(texts) if not isinstance(texts, np.ndarray) else (None, texts)
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, b
        a = b


def pieces(texts: pa.Array, separators: np.ndarray, most: int = SLICE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """The texts, those of more than ``most`` bytes cut before separators (ASCII characters), and the row of each piece.

    A word is never cut: a piece without a separator goes on to the next one."""
    data, at = buffers(texts)
    n = np.ones(len(at) - 1, np.int64)
    cuts: dict[int, np.ndarray] = {}
    for row in np.flatnonzero(np.diff(at) > most).tolist():
        spots = np.flatnonzero(separators[data[at[row] : at[row + 1]]]) + at[row]
        place = np.unique(np.searchsorted(spots, np.arange(at[row] + most, at[row + 1], most)))
        cuts[row] = spots[place[place < len(spots)]]
        n[row] += len(cuts[row])
    rows = np.repeat(np.arange(len(n)), n)
    begins = at[rows]
    first = np.cumsum(n) - n
    for row, cut in cuts.items():
        begins[first[row] + 1 : first[row] + n[row]] = cut
    ends = np.append(begins, at[-1])
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data)), rows


def columns(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
