"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

p(word | context) = p(class | context) * p(word | class, context). Classes: the end of the text, the ``FREQUENT`` most frequent words in bins of about
equal mass, and the rest in ``REST`` classes by hash. Within a class a word starts from its smoothed corpus count and has weights for the word before and the two words before (``inside``).
The rest words of a class share these weights in buckets by hash, about as many as there are such words; within a bucket a word has its count, and every bucket keeps the mass of one unknown
word, so the model is a distribution over all words. p(class | context) is a softmax over hashed features: the word before, the two words before, and the word before that
one (a skip). Its weights are trained by distributed gradient updates: in each round Spark sums expected counts per feature over all training
documents, in the first one observed counts too, and the step is their difference, scaled by the expected count. Scoring runs in numpy batches that touch only the
weight rows of the features present.

Corpus counts cover all training tokens. They stay in Spark: words past the frequent ones are joined by shuffle, and since every frequent word is looked up in
the task, no shuffled word is hot. The driver holds the frequent words, the weights of the classes and the masses of the buckets, all of sizes bounded by parameters; the weights inside the
classes are made and used in tasks, and are as many as the distinct n-grams. Words are known by 64-bit hashes.

Defined results: a null or empty text is just its end token. A null id is a training document. Rows are scored one by one, so repeated rows and ids have each their own result.
Without any training document every count is 0 and the class model is even. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import inside as I, words as W
from .tasks import stage

FREQUENT = 1 << 17
BINS, REST = 11, 4
MOST_BUCKETS = 1 << 19
CLASSES = 1 + BINS + REST
BUCKETS = (4096, 2048, 2048)  # of the three kinds of feature
FEATURES = sum(BUCKETS)
ROUNDS = 3
DAMPING = 5.0
MOST_STEP = 1.0
SLOTS = 20  # bits of the lookup table of frequent words
AT_ONCE = 1 << 16
COUNT_BYTES = 4 << 20
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
SCORED = (
    "part INT, row BIGINT, doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, known BIGINT, base DOUBLE, classes DOUBLE, rest ARRAY<BIGINT>, times ARRAY<INT>, packed BINARY"
)
COLUMNS = [c.split()[0] for c in SCORED.split(", ")]
KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes of the frequent words, the end among them
    counts: np.ndarray
    bins: np.ndarray  # class of each
    slots: np.ndarray  # top bits of a hash → place in ``words``, -1 for none, -2 for more than one
    weights: np.ndarray  # features x classes
    bias: np.ndarray  # log of the classes' shares
    lift: np.ndarray  # log10 of denominator over class mass
    denominator: float
    tokens: int
    ranks: np.ndarray  # unit of each frequent word, by falling count
    masses: np.ndarray  # of each unit: the frequent words, then the buckets of the others
    hot: int  # units below it are words that ``inside`` never takes alone as a context


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each text's words and its end, and row offsets."""
    found = W.words_of(texts, fold=W.LOWER)
    return np.insert(found.hashes, found.first[1:], END), found.first + np.arange(len(found.first))


def features(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row of the weights for each token and kind of feature."""
    before = np.empty(len(tokens), np.uint64)
    before[1:] = tokens[:-1]
    before[first[:-1]] = BEGIN
    second = np.empty(len(tokens), np.uint64)
    second[1:] = before[:-1]
    second[first[:-1]] = BEGIN
    keys = (W.mix(before), W.mix(before * np.uint64(W.GRAM_BASE) + second), W.mix(second + np.uint64(1)))
    starts = np.cumsum((0, *BUCKETS[:-1]))
    return tuple((k >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) + s for k, n, s in zip(keys, BUCKETS, starts, strict=True))


def places(model: Model, tokens: np.ndarray) -> np.ndarray:
    """Place among the frequent words, -1 for others."""
    at = model.slots[tokens >> np.uint64(64 - SLOTS)].astype(np.int64)
    crowded = np.flatnonzero(at == -2)
    at[crowded] = np.minimum(np.searchsorted(model.words, tokens[crowded]), len(model.words) - 1)
    at[(at >= 0) & (model.words[at] != tokens)] = -1
    return at


def classes_of(model: Model, tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(place >= 0, model.bins[place], 1 + BINS + (tokens & np.uint64(REST - 1)).astype(np.int64))


def raw_shares(model: Model, rows: tuple[np.ndarray, ...], a: int, b: int) -> np.ndarray:
    """Logs of the classes' weights for tokens a to b, the largest 0."""
    z = model.bias + model.weights[rows[0][a:b]]
    for r in rows[1:]:
        z += model.weights[r[a:b]]
    z -= z.max(axis=1, keepdims=True)
    return z


def log_shares(model: Model, rows: tuple[np.ndarray, ...], a: int, b: int) -> np.ndarray:
    """Log probabilities of the classes for tokens a to b."""
    z = raw_shares(model, rows, a, b)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def count_words(batches):
    """Texts → word hash and its count in a block of texts."""
    for batch in batches:
        for a, b in W.slices(batch.column(0), COUNT_BYTES):
            tokens, _ = tokens_of(batch.column(0).slice(a, b - a))
            words, n = np.unique(tokens, return_counts=True)
            yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def summed_by(rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """out[r] += the sum of the values of row r."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    cut = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out[rows[cut]] += np.add.reduceat(values[order], cut, axis=0)


def gradient(shared, observed: bool):
    """Texts → per feature the expected counts of the classes, after the observed ones if these are asked for, as one array."""

    def task(batches):
        model = Model(*shared.value)
        seen, expected = np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES))
        for batch in batches:
            for a, b in W.slices(batch.column(0)):
                tokens, first = tokens_of(batch.column(0).slice(a, b - a))
                rows = features(tokens, first)
                for low in range(0, len(tokens), AT_ONCE):
                    high = min(low + AT_ONCE, len(tokens))
                    share = np.exp(raw_shares(model, rows, low, high))
                    share /= share.sum(axis=1, keepdims=True)
                    for r in rows:
                        summed_by(r[low:high], share, expected)
                if observed:
                    right = classes_of(model, tokens, places(model, tokens))
                    for r in rows:
                        seen += np.bincount(r * CLASSES + right, minlength=FEATURES * CLASSES).reshape(FEATURES, CLASSES)
        used = np.flatnonzero(expected.sum(axis=1))
        values = np.concatenate((seen[used], expected[used]), axis=1) if observed else expected[used]
        yield pa.record_batch([pa.array(used, pa.int32()), *[pa.array(values[:, k]) for k in range(values.shape[1])]], ["feature", *[f"v{k}" for k in range(values.shape[1])]])

    return task


def train(docs: DataFrame, text: str, doc_id: str, training: Column) -> tuple[Model, DataFrame]:
    """The model and all word counts (word, c)."""
    spark = docs.sparkSession
    given = docs.where(training).select(F.col(text).alias("text"))
    counts = stage(given.mapInArrow(count_words, "word BIGINT, n BIGINT").groupBy("word").agg(F.sum("n").alias("c")), "maxent-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the model's frequent words, a fixed number, the end of the text always among them
    end = F.col("word") == int(END.view(np.int64))
    top = counts.where(~end).orderBy(F.desc("c"), "word").limit(FREQUENT).union(counts.where(end)).toPandas()
    buckets = buckets_for(int(distinct) - len(top))
    rest = counts.groupBy(F.col("word").bitwiseAND(buckets - 1).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    model = prepared(top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), rest, buckets, int(total), int(distinct))
    observed = None
    for k in range(ROUNDS if total else 0):
        shared = spark.sparkContext.broadcast(tuple(model._replace(masses=model.masses[:0])))
        n = CLASSES if k else 2 * CLASSES
        kinds = ", ".join(["feature INT", *[f"v{j} DOUBLE" for j in range(n)]])
        sums = given.mapInArrow(gradient(shared, not k), kinds).groupBy("feature").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(n)])
        rows = sums.toPandas().sort_values("feature")
        values = rows.drop(columns="feature").to_numpy()
        expected = values[:, -CLASSES:]
        observed = observed if k else values[:, :CLASSES]
        step = (observed - expected) / (expected + DAMPING) / len(BUCKETS) * 2
        weights = model.weights.copy()
        weights[rows["feature"].to_numpy(np.int64)] += np.clip(step, -MOST_STEP, MOST_STEP).astype(np.float32)
        shared.unpersist()
        model = model._replace(weights=weights)
    return model, counts


def buckets_for(n_rest: int) -> int:
    """Buckets for so many words: at least one per class, else no more than there are words."""
    return min(REST << (max(n_rest // REST, 1).bit_length() - 1), MOST_BUCKETS)


def prepared(words: np.ndarray, counts: np.ndarray, rest: pa.Table, buckets: int, total: int, distinct: int) -> Model:
    """Bins, masses and the lookup table; weights are nought. ``rest`` has the counts of all words by bucket."""
    if END not in words:  # nothing was learned
        words, counts = np.append(words, END), np.append(counts, 0)
    share = counts.astype(float).copy()
    share[words == END] = 0
    middle = np.cumsum(share) - share / 2
    bins = 1 + np.minimum((middle / max(share.sum(), 1) * BINS).astype(np.int64), BINS - 1)
    bins[words == END] = 0
    mass = np.bincount(bins, counts + 0.5, CLASSES)
    n_rest, c_rest = np.zeros(buckets), np.zeros(buckets)
    k = rest["k"].to_numpy()
    c_rest[k], n_rest[k] = rest["c"].to_numpy(), rest["n"].to_numpy()
    low = (words & np.uint64(buckets - 1)).astype(np.int64)
    real = counts > 0
    c_rest -= np.bincount(low, counts, buckets)
    n_rest -= np.bincount(low[real], minlength=buckets)
    bucket_mass = c_rest + 0.5 * n_rest + 0.5  # and one unknown word
    mass[1 + BINS :] = np.bincount(np.arange(buckets) % REST, bucket_mass, REST)
    masses, hot = np.concatenate((counts + 0.5, bucket_mass)), int((counts[words != END] > I.HOT).sum())
    mass = np.maximum(mass, 0.5)
    denominator = total + 0.5 * (distinct + 1)
    order = np.argsort(words)
    words, counts, bins, ranks = words[order], counts[order], bins[order], order.astype(np.int32)
    slot = (words >> np.uint64(64 - SLOTS)).astype(np.int64)
    slots = np.full(1 << SLOTS, -1, np.int32)
    slots[slot] = np.arange(len(words))
    slots[slot[1:][slot[1:] == slot[:-1]]] = -2
    return Model(words, counts, bins, slots, np.zeros((FEATURES, CLASSES), np.float32), np.log(mass / mass.sum()).astype(np.float32), np.log10(denominator / mass), float(denominator), total, ranks, masses, hot)


def units_of(model: Model, tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The unit of each token: its rank among the frequent words, or its bucket."""
    buckets = len(model.masses) - len(model.words)
    return np.where(place >= 0, model.ranks[place], len(model.words) + (tokens & np.uint64(buckets - 1)).astype(np.int64))


def unit_classes(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and mass of each class."""
    kinds = np.empty(len(model.masses), np.int64)
    kinds[model.ranks] = model.bins
    buckets = len(model.masses) - len(model.words)
    kinds[len(model.words) :] = 1 + BINS + np.arange(buckets) % REST
    return kinds, np.bincount(kinds, model.masses, CLASSES)


def batch_of(**columns) -> pa.RecordBatch:
    """A batch of ``SCORED``; columns not given are null."""
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(COLUMNS, KINDS, strict=True)], COLUMNS)


class Sent:
    """Tokens of a task that wait until they fill a block."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n, self.row = parts, [], 0, 0

    def add(self, keys: np.ndarray, kind: np.ndarray, row: np.ndarray, trained: np.ndarray, begin: int):
        """Tokens of the texts from ``begin`` on; the end of a text, alone in its class, isn't sent."""
        if not self.held:
            self.row = begin
        some = kind != 0
        marks = ((row[some] + (begin - self.row)) << 1 | trained[row[some]]).astype(np.uint32)
        self.held.append((keys[some], marks, I.parts_of(keys[some], kind[some], self.parts)))
        self.n += len(marks)
        if self.n >= I.TOKENS_A_BLOCK:
            yield from self.sent()

    def sent(self):
        if self.n:
            found = [*zip(*I.packed(*(np.concatenate(x) for x in zip(*self.held, strict=True))), strict=True)]
            yield batch_of(part=found[0], row=[self.row] * len(found[0]), n_tokens=found[1], packed=found[2])
        self.held, self.n = [], 0


def score_texts(shared, parts: int):
    """(id, held out, text) → what the task knows of each score, and the words that must be looked up; besides, blocks of tokens for each part that weighs words inside their classes."""

    def task(batches):
        model = Model(*shared.value)
        frequent = np.log10((model.counts + 0.5) / model.denominator)
        at, waiting = TaskContext.get().partitionId() << 40, Sent(parts)
        for batch in batches:
            texts = batch.column(2)
            for a, b in W.slices(texts):
                tokens, first = tokens_of(texts.slice(a, b - a))
                row = np.repeat(np.arange(b - a), np.diff(first))
                place = places(model, tokens)
                right = classes_of(model, tokens, place)
                rows = features(tokens, first)
                picked = np.empty(len(tokens))
                for low in range(0, len(tokens), AT_ONCE):
                    high = min(low + AT_ONCE, len(tokens))
                    picked[low:high] = log_shares(model, rows, low, high)[np.arange(high - low), right[low:high]]
                classes = np.bincount(row, picked / np.log(10) + model.lift[right], b - a)
                here = place >= 0
                base = np.bincount(row[here], frequent[place[here]], b - a)
                known = np.bincount(row[here], model.counts[place[here]] > 0, b - a).astype(np.int64)
                # the other words, each once per text
                order = np.lexsort((tokens[~here], row[~here]))
                rest_row, rest = row[~here][order], tokens[~here][order]
                new = np.flatnonzero(np.concatenate((np.ones(min(1, len(rest)), bool), (rest[1:] != rest[:-1]) | (rest_row[1:] != rest_row[:-1]))))
                times = np.diff(np.append(new, len(rest)))
                offsets = np.searchsorted(rest_row[new], np.arange(b - a + 1))
                yield pa.record_batch(
                    [pa.array((np.arange(at, at + b - a) % parts).astype(np.int32)), pa.array(np.arange(at, at + b - a)),
                     batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), pa.array(known), pa.array(base), pa.array(classes),
                     W.columns(rest[new].view(np.int64), offsets, pa.int64()), W.columns(times.astype(np.int32), offsets, pa.int32()), pa.nulls(b - a, pa.binary())],
                    COLUMNS,
                )
                keys = I.keys_of(units_of(model, tokens, place), first, len(model.masses), model.hot)
                trained = ~batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                yield from waiting.add(keys, right, row, trained, at)
                at += b - a
        yield from waiting.sent()

    return task


def weigh_inside(shared):
    """Rows of ``score_texts`` of one part → the texts' rows as they are, and for each block of tokens what their contexts add to its texts, as numbers of rows and logs."""

    def task(batches):
        blocks = []
        for batch in batches:
            sent = batch.column("packed").is_valid()
            yield batch.filter(pc.invert(sent))
            blocks += batch.filter(sent).select(["part", "row", "n_tokens", "packed"]).to_pylist()
        if not blocks:
            return
        model = Model(*shared.value)
        blocks.sort(key=lambda b: (b["row"], b["part"]))
        ends = np.cumsum([0, *(b["n_tokens"] for b in blocks)])
        keys, marks = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
        for b, low, high in zip(blocks, ends[:-1], ends[1:], strict=True):
            keys[low:high], marks[low:high] = I.unpacked(b.pop("packed"), b["n_tokens"])
        gains = I.gains(keys, marks & 1, model.masses, *unit_classes(model))
        for b, low, high in zip(blocks, ends[:-1], ends[1:], strict=True):
            row = marks[low:high] >> 1
            cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            sums = np.add.reduceat(gains[low:high], cut).astype(np.float32)
            yield batch_of(part=[b["part"]], row=[b["row"]], n_tokens=[len(cut)], packed=[row[cut].tobytes() + sums.tobytes()])

    return task


def add_up(batches):
    """Blocks of rows and logs → row and the sum of its logs."""
    blocks = [b for batch in batches for b in batch.to_pylist()]
    if not blocks:
        return
    blocks.sort(key=lambda b: (b["row"], b["part"]))
    rows = np.concatenate([np.frombuffer(b["packed"], np.uint32, b["n_tokens"]).astype(np.int64) + b["row"] for b in blocks])
    logs = np.concatenate([np.frombuffer(b["packed"], np.float32, b["n_tokens"], 4 * b["n_tokens"]).astype(float) for b in blocks])
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    cut = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    yield pa.record_batch([pa.array(rows[cut]), pa.array(np.add.reduceat(logs[order], cut))], ["row", "inside"])


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row, learning from those not held out."""
    held = F.coalesce(held_out, F.lit(False))
    model, counts = train(docs, text, doc_id, ~held)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    parts = max(-(-model.tokens // I.TOKENS_A_TASK), I.LEAST_PARTS)
    both = stage(given.mapInArrow(score_texts(shared, parts), SCORED).repartitionById(parts, "part").mapInArrow(weigh_inside(shared), SCORED), "maxent-scored")
    scored = both.where("packed IS NULL").drop("part", "packed")
    inside = both.where("packed IS NOT NULL").select("part", "row", "n_tokens", "packed").repartition("row").mapInArrow(add_up, "row BIGINT, inside DOUBLE")
    looked_up = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    found = looked_up.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(model.denominator))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return scored.drop("rest", "times").join(found, "row", "left").join(inside, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("classes") + F.coalesce("inside", F.lit(0.0)) / math.log(10)).alias("score"),
    )
