"""Quality rules from tokeniser fertility.

Two public vocabularies measure each text: a piece vocabulary with byte fallback and a byte-level one. A text's tokens are those of its words, each encoded
with the space before it. From these come characters per token under either vocabulary, the share of fallback bytes, and the entropy of
the piece tokens. A word that recurs in a block of texts is encoded once.

Rejection bands: documents are grouped by language (by script where it is null) and by the power of two of the characters of their words, on which
entropy depends and which bad fertility doesn't change. Where fewer than ``LEAST_DOCS`` documents of such a group pass the base rules, the band is that of the language,
else of the script, else of all documents, however few; so every document has one. A measure may lie ``REACH`` interquartile ranges beyond the group's
quartiles; the ranges have a floor so that a uniform group doesn't reject on trifles. A group of all lengths gives way in entropy by one bit for each doubling
of the characters past its quartiles of length, more than which length alone can't add or take. Quartiles are taken over all documents by Spark.

Defined results: a null or empty text has no words and fails the base rules; its measures are null. Repeated rows are measured alike and both count. A null language uses the script of the text's first letter.
Columns of the input are kept; one named like an output column is replaced. Texts are read whole.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .tasks import let, packed, stage, unpacked

VOCABULARIES = "/opt/tokenizers"  # where the files lie on every node
PIECES, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
REACH = 3.0  # of the far-out fence
LEAST_DOCS = 40
LEVELS = 4  # of groups: language and size, language, script, all documents
FLOORS = {"piece_chars": 0.15, "byte_chars": 0.15, "fallback": 0.01, "entropy": 0.15}
BLOCK_BYTES = 4 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = tuple(FLOORS)
OUTPUT = "STRUCT<n_words: BIGINT, word_chars: BIGINT, n_symbols: BIGINT, n_dup_lines: BIGINT, n_repeat_words: BIGINT, n_tokens: BIGINT, piece_chars: DOUBLE, byte_chars: DOUBLE, fallback: DOUBLE, entropy: DOUBLE>"
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")

_loaded: dict[str, tuple] = {}


def vocabularies(folder: str) -> tuple:
    """Both encoders and which piece ids are fallback bytes, loaded once per Python worker."""
    if folder not in _loaded:
        import sentencepiece
        import tiktoken

        spec = importlib.util.spec_from_file_location("public_vocabularies", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        with open(os.path.join(folder, BYTE_RANKS), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        bytes_bpe = tiktoken.Encoding("byte_bpe", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
        fallback = np.array([pieces.is_byte(i) or pieces.is_unknown(i) for i in range(pieces.get_piece_size())])
        _loaded[folder] = (pieces, bytes_bpe, fallback)
    return _loaded[folder]


def duplicate_lines(text: str | None) -> int:
    lines = (text or "").split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[str] = set()
    count = 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            count += line in seen
            seen.add(line)
    return count


def repeated_words(found: W.Words, size: int = 3) -> np.ndarray:
    """Words per row that lie in a window of ``size`` words found twice or more in the row."""
    at, _ = W.gram_starts(found.first, size)
    rows = len(found.first) - 1
    if not len(at):
        return np.zeros(rows, np.int64)
    row = found.rows()
    key = W.mix(W.grams(found.hashes, size)[at] + row[at].astype(np.uint64) * np.uint64(W.BASE))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(found.hashes) + 1, np.int64)
    np.add.at(change, at[again], 1)
    np.add.at(change, at[again] + size, -1)
    return np.bincount(row, np.cumsum(change[:-1]) > 0, rows).astype(np.int64)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[first[1:]] - sums[first[:-1]]


def measure(texts: pa.Array, folder: str) -> pa.Array:
    out = [[] for _ in range(10)]
    pieces, bytes_bpe, is_fallback = vocabularies(folder)
    for a, b in W.slices(texts, BLOCK_BYTES):
        part = texts.slice(a, b - a)
        found = W.words_of(part)
        raw, at = W.buffers(part)
        n_words = np.diff(found.first)
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        chars = points[found.ends] - points[found.starts]
        word_chars = per_row(chars, found.first)
        _, index, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        distinct = [raw[x:y].tobytes().decode() for x, y in zip(found.starts[index].tolist(), found.ends[index].tolist(), strict=True)]
        ids = pieces.encode(distinct, num_threads=1) if distinct else []
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
        base = np.concatenate(([0], np.cumsum(size)))
        fallen = np.diff(np.concatenate(([0], np.cumsum(is_fallback[flat])))[base])
        encode = bytes_bpe.encode_ordinary
        byte_size = np.array([len(encode(" " + w)) for w in distinct], np.int64)
        n_tokens = per_row(size[inverse], found.first)
        n_bytes = per_row(byte_size[inverse], found.first)
        n_fallen = per_row(fallen[inverse], found.first)
        with np.errstate(divide="ignore", invalid="ignore"):
            measures = (word_chars / n_tokens, word_chars / n_bytes, n_fallen / n_tokens, entropies(flat, base, size, inverse, found, len(is_fallback), n_tokens))
        columns = (
            n_words, word_chars, per_row(SYMBOLS[raw], at), np.array([duplicate_lines(t.as_py()) for t in part], np.int64), repeated_words(found), n_tokens, *measures,
        )
        for held, values in zip(out, columns, strict=True):
            held.append(values)
    names = [f.split(":")[0].strip() for f in OUTPUT.removeprefix("STRUCT<").removesuffix(">").split(",")]
    arrays = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64() if k < 6 else pa.float64(), from_pandas=True) for k, v in enumerate(out)]
    return pa.StructArray.from_arrays(arrays, names)


def entropies(flat: np.ndarray, base: np.ndarray, size: np.ndarray, inverse: np.ndarray, found: W.Words, vocabulary: int, totals: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits of each row's piece tokens."""
    count = size[inverse]
    row = np.repeat(found.rows(), count)
    ends = np.cumsum(count)
    token = flat[np.repeat(base[inverse] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
    key = np.sort(row * vocabulary + token)
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    c = np.diff(np.append(begin, len(key))).astype(float)
    weight = np.bincount(key[begin] // vocabulary, c * np.log2(c), len(totals))
    return np.log2(totals) - weight / totals


def measurer(folder: str):
    def task(texts: pa.Array) -> pa.Array:
        return measure(texts, folder)

    task.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(task, OUTPUT).asNondeterministic()


def script_of(text: Column) -> Column:
    """Script of the first letter."""

    def named(letter: Column) -> Column:
        found = F.lit("other")
        for s in reversed(SCRIPTS):
            found = F.when(letter.rlike(rf"\p{{Is{s}}}"), s.lower()).otherwise(found)
        return F.concat(F.lit("script:"), found)

    return let(F.regexp_extract(text, r"\p{L}", 0), named)


def groups_of() -> Column:
    """The groups of a document, finest first, one per row as struct(level, key, size)."""
    every = F.lit(-1)
    levels = ((F.col("_group"), F.col("_size")), (F.col("_group"), every), (F.col("_script"), every), (F.lit(""), every))
    return F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), key.alias("_key"), size.alias("_cell")) for k, (key, size) in enumerate(levels)])).alias("_g")


def bands_of(measured: DataFrame, reach: float) -> DataFrame:
    """_group, _script, _size → low and high of each measure, from the finest group that is large enough."""
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 1000).alias(c)
    slack = lambda m: reach * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(FLOORS[m]))
    level = ("_level", "_key", "_cell")
    passed = measured.where("NOT base_failed").select(groups_of(), "_length", *MEASURES).select("_g.*", "_length", *MEASURES)
    groups = passed.groupBy(*level).agg(F.count("*").alias("_n"), *[quartiles(m) for m in (*MEASURES, "_length")]).where((F.col("_n") >= LEAST_DOCS) | (F.col("_level") == LEVELS - 1))
    fences = [x for m in MEASURES for x in ((F.col(m)[0] - slack(m)).alias(f"_low_{m}"), (F.col(m)[1] + slack(m)).alias(f"_high_{m}"))]
    lengths = [F.when(F.col("_level") > 0, F.col("_length")[k]).alias(n) for k, n in enumerate(("_short", "_long"))]
    bands = groups.select(*level, F.struct(*fences, *lengths).alias("_band"))
    cells = measured.select("_group", "_script", "_size").distinct()
    asked = cells.select("*", groups_of()).select("_group", "_script", "_size", "_g.*")
    return asked.join(bands, list(level)).groupBy("_group", "_script", "_size").agg(F.min_by("_band", "_level").alias("_band")).select("_group", "_script", "_size", "_band.*")


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", folder: str = VOCABULARIES, reach: float = REACH) -> DataFrame:
    """``docs`` without the text, with all measures, ``base_failed``, ``kept`` and ``reasons`` (measures out of band, joined by commas)."""
    fields = [f.split(":")[0].strip() for f in OUTPUT.removeprefix("STRUCT<").removesuffix(">").split(",")]
    own = {*fields, "base_failed", "kept", "reasons", text}
    script = script_of(F.coalesce(F.col(text), F.lit("")))
    others = [c for c in docs.columns if c not in own]
    measured = docs.select(packed(others).alias("_kept"), F.col(lang).cast("string").alias("_group"), script.alias("_script"), measurer(folder)(F.col(text)).alias("_m")).select("*", "_m.*").drop("_m")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    length = F.log2(F.greatest("word_chars", F.lit(1)).cast("double"))
    measured = stage(measured.withColumns({"base_failed": failed, "_group": F.coalesce("_group", "_script"), "_length": length, "_size": F.floor(length).cast("int")}), "fertility")
    joined = measured.join(bands_of(measured, reach), ["_group", "_script", "_size"], "left")
    low, high = ({m: F.col(f"_{side}_{m}") for m in MEASURES} for side in ("low", "high"))
    low["entropy"] -= F.greatest(F.coalesce(F.col("_short") - F.col("_length"), F.lit(0.0)), F.lit(0.0))
    high["entropy"] += F.greatest(F.coalesce(F.col("_length") - F.col("_long"), F.lit(0.0)), F.lit(0.0))
    out = [F.when((F.col(m) < low[m]) | (F.col(m) > high[m]), F.lit(m)) for m in MEASURES]
    judged = joined.withColumn("reasons", F.concat_ws(",", *out)).withColumn("kept", ~F.col("base_failed") & (F.col("reasons") == ""))
    return judged.select(*unpacked("_kept", others), *fields, "base_failed", "reasons", "kept")
