"""Language identification by error-correcting output codes.

Each language has a codeword of plus and minus ones. For each bit a binary classifier over hashed byte trigrams
(naive Bayes log ratios, counted on all training rows by Spark) says which half of the languages a text
belongs to. Decoding sums each bit's logistic loss, weighted by how well that bit separates its halves,
and takes the codeword of least loss. Up to five languages have the exhaustive code, more a dense random one.

Defined results: a null text, an empty one and one without a letter give ``und`` and score 0; so does every text if
nothing was learned. Equal losses go to the language first in code point order and are ambiguous. Repeated rows weigh as often as they
stand there. Columns of the input are kept; one named like an output column is replaced. Texts are read whole.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .tasks import stage, unused

FEATURES = 1 << 14
SMOOTHING = 0.5
AMBIGUOUS = 0.2  # least lead of the best language's score over the second's
STEP = 1 << 18  # trigrams looked up at once
UNKNOWN = "und"
PREDICTED = "STRUCT<lang_pred: STRING, score: DOUBLE, runner_up: STRING, ambiguous: BOOLEAN>"

LETTER = ~W.NON_WORD
LETTER[0x30:0x3A] = False


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # per bit


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each trigram with two letter bytes or more, and its row. Other characters count as a space."""
    data, at = W.buffers(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = LETTER[data]
    low = np.where(letter, data, 32).astype(np.uint32)
    sure = letter.astype(np.int8)
    ok = (sure[:-2] + sure[1:-1] + sure[2:]) >= 2
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok &= row[:-2] == row[2:]
    where = np.flatnonzero(ok)
    key = low[where] | (low[where + 1] << np.uint32(8)) | (low[where + 2] << np.uint32(16))
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64), row[where]


def codewords(n: int) -> np.ndarray:
    """The exhaustive code for up to five languages, else the best of some dense random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        rows = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(rows, float).T
    bits = int(np.ceil(10 * np.log2(n)))
    random, best, found = np.random.Generator(np.random.PCG64(7)), -1, None
    for _ in range(200):
        code = random.choice((-1.0, 1.0), size=(n, bits))
        near = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if near > best and (np.abs(code.sum(axis=0)) < n).all():
            best, found = near, code
    return found


def _count(batches):
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0), batch.column(1).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for a, b in W.slices(texts):
            feature, row = trigrams(texts.slice(a, b - a))
            counts = np.bincount(codes[a:b][row] * FEATURES + feature, minlength=len(names) * FEATURES).reshape(-1, FEATURES)
            for name, line in zip(names, counts, strict=True):
                held[name] = held.get(name, 0) + line
        if len(held) > 64:
            yield from _flushed(held)
            held = {}
    yield from _flushed(held)


def _flushed(held: dict[str, np.ndarray]):
    for name, line in held.items():
        at = np.flatnonzero(line)
        yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(line[at], pa.int64())], ["lang", "feature", "n"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts all rows with a text and a language. What reaches the driver is one row per feature and one per language."""
    given = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    pairs = given.select(F.lower(F.col(text)), F.col(lang))
    counts = pairs.mapInArrow(_count, "lang STRING, feature INT, n BIGINT").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = stage(counts, "ecoc-counts")
    languages = sorted(r[0] for r in given.select(lang).distinct().collect())
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((FEATURES, 1)), np.ones(1))
    signs = labelled.sparkSession.createDataFrame([(n, [bool(x > 0) for x in c]) for n, c in zip(languages, code, strict=True)], "lang STRING, bits ARRAY<BOOLEAN>")
    sums = [F.sum(F.when(F.col("bits")[j], F.col("n")).otherwise(0)).alias(f"b{j}") for j in range(code.shape[1])]
    rows = counts.join(signs, "lang").groupBy("feature").agg(F.sum("n").alias("n"), *sums).toPandas()
    on, off = np.zeros((FEATURES, code.shape[1])), np.zeros((FEATURES, code.shape[1]))
    at = rows["feature"].to_numpy(np.int64)
    on[at] = rows[[f"b{j}" for j in range(code.shape[1])]].to_numpy(float)
    off[at] = rows["n"].to_numpy(float)[:, None] - on[at]
    p = (on + SMOOTHING) / (on + SMOOTHING).sum(axis=0)
    q = (off + SMOOTHING) / (off + SMOOTHING).sum(axis=0)
    weights = np.log(p / q)
    trust = ((p - q) * weights).sum(axis=0)  # symmetric divergence of the halves
    return Model(languages, code, weights, trust / trust.sum() if trust.sum() > 0 else np.full(len(trust), 1 / len(trust)))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Rows x languages, each row a distribution; rows without a trigram are even."""
    out = np.zeros((len(texts), len(model.languages)))
    for a, b in W.slices(texts):
        feature, row = trigrams(texts.slice(a, b - a))
        sums = np.zeros((b - a, model.weights.shape[1]))
        for i in range(0, len(feature), STEP):
            part = row[i : i + STEP]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            sums[part[cut]] += np.add.reduceat(model.weights[feature[i : i + STEP]], cut, axis=0)
        n = np.bincount(row, minlength=b - a)
        z = sums / np.sqrt(np.maximum(n, 1))[:, None]  # neighbouring trigrams overlap: less than a sum of independent evidence
        loss = np.einsum("rlb,b->rl", np.logaddexp(0, -z[:, None, :] * model.code[None]), model.trust * len(model.trust))
        like = np.exp(loss.min(axis=1, keepdims=True) - loss)
        out[a:b] = like / like.sum(axis=1, keepdims=True)
    return out


def predictor(model: Model):
    """Arrow function: lower-case texts and whether each has a letter → struct of ``PREDICTED``."""

    def predict(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        known = len(model.languages)
        has = np.array(lettered.fill_null(False).to_pylist(), bool) & (known > 0)
        if not known:
            none = pa.array([UNKNOWN] * len(texts))
            return pa.StructArray.from_arrays([none, pa.array([0.0] * len(texts)), pa.nulls(len(texts), pa.string()), pa.array([True] * len(texts))], ["lang_pred", "score", "runner_up", "ambiguous"])
        p = scores(model, texts)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(p))
        best, second = order[:, 0], order[:, min(1, known - 1)]
        lead = p[rows, best] - (p[rows, second] if known > 1 else 0.0)
        names = np.array(model.languages, object)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.where(has, names[best], UNKNOWN), pa.string()), pa.array(np.where(has, p[rows, best], 0.0)),
                pa.array(np.where(has & (known > 1), names[second], None), pa.string()), pa.array(~has | (lead < AMBIGUOUS)),
            ],
            ["lang_pred", "score", "runner_up", "ambiguous"],
        )

    predict.__annotations__ = {"texts": pa.Array, "lettered": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, PREDICTED).asNondeterministic()


def identify(docs: DataFrame, model: Model, text: str | Column = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``runner_up`` and ``ambiguous``. Only the text reaches Python."""
    column = F.col(text) if isinstance(text, str) else text
    found = predictor(model)(F.lower(column), F.coalesce(column.rlike(r"\p{L}"), F.lit(False)))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "runner_up", "ambiguous")]
    held = unused(docs.columns, "found")
    return docs.withColumn(held, found).select(*kept, f"{held}.*")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is of the fold; a null id is of none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
