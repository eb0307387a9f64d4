"""Mixing sources to target weights: token weights raked to source, language and topic marginals, then sampling.

Iterative proportional fitting finds a factor per source, language and topic such that the weighted tokens have all three target
marginals. Languages and topics form a small grid (checked against ``MOST_CELLS``); sources may be many, so their factors stay in
a Spark table with one row per source and the grid's token counts as an array. One sweep is one aggregation of that table to the grid's
sums; only those reach the driver. A document is expected ``share * weight`` times in the sample: so many whole copies, and one more
with the calibrated probability that remains, decided by a hash of its id and text.

Where no targets are given, a marginal is the corpus's own tempered by an exponent. Targets are scaled to the categories that have tokens. Fitting
ends at ``TOLERANCE`` or, if the targets contradict empty cells, when the largest deviation no longer falls; that deviation is returned as ``fit_error``, and ``mix`` fails where targets that were given are missed by more than ``MOST_ERROR``.

Defined results: a null source, language or topic is the category '(none)'; a null or empty text has no tokens, adds nothing and gets its
cell's weight; a source without tokens weighs 0. Repeated rows count and are drawn alike. An empty table gives an empty one. Input columns are kept; one named
like an output column is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .tasks import let, stage, unused

NONE = "(none)"
OTHER = "(other)"
WORD = r"[^\x20\x09-\x0D]+"
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.7}
SHARE = 0.5
TOLERANCE = 1e-10
STALLED = (8, 0.999)  # sweeps over which the error must fall to less than this part of itself
MOST_ERROR = 0.01  # share of the tokens by which a given target may be missed
MOST_CELLS = 4096
OUTPUT = ("tokens", "topic", "weight", "expected", "copies", "fit_error")
# Fixed seed words per topic.
TOPICS = {
    "contact": ("mail", "email", "phone", "tel", "fax", "address", "contact"),
    "law": ("license", "licence", "copyright", "warranty", "permission", "rights", "liability", "law", "court"),
    "software": ("software", "code", "function", "server", "token", "password", "http", "https", "api", "key"),
    "trade": ("price", "buy", "sale", "order", "shipping", "market", "offer", "free"),
}
GENERAL = "general"


class Factors(NamedTuple):
    sources: DataFrame  # source, factor
    langs: list[str]
    topics: list[str]
    grid: np.ndarray  # languages x topics: language factor times topic factor
    error: float
    sweeps: int


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """The topic whose seed words stand in the text most often, the first of equal ones, ``GENERAL`` where there are none."""
    words = sorted({w for ws in topics.values() for w in ws}, key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(" + "|".join(words) + r")\b"), F.lit(0))
    topic = F.create_map(*[F.lit(x) for name, ws in topics.items() for w in ws for x in (w, name)])

    def most(names: Column) -> Column:
        counts = [F.struct(F.size(F.array_remove(names, n)).alias("others"), F.lit(i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(topics)]
        return F.when(F.size(names) > 0, F.array_min(F.array(*counts))["name"]).otherwise(F.lit(GENERAL))

    return let(F.transform(found, lambda w: F.element_at(topic, F.lower(w))), most)


def tempered(tokens: dict[str, float], power: float) -> dict[str, float]:
    return {k: v**power for k, v in tokens.items() if v > 0}


def scaled(targets: dict[str, float], names: list[str], tokens: np.ndarray) -> np.ndarray:
    """Targets in the order of the names, nought where there are no tokens, of sum 1."""
    raw = np.array([targets.get(n, 0.0) for n in names]) * (tokens > 0)
    return raw / raw.sum() if raw.sum() > 0 else raw


def fit(
    documents: DataFrame, source_targets: dict[str, float] | None = None, lang_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None,
    temper: dict[str, float] | None = None,
) -> Factors:
    """Rakes ``documents`` (source, lang, topic, tokens; no nulls). Categories a given target dict doesn't name are '(other)' of its target."""
    temper = TEMPER | (temper or {})
    named = lambda c, targets: F.col(c) if targets is None else F.when(F.col(c).isin(list(targets)), F.col(c)).otherwise(F.lit(OTHER))
    cells = stage(
        documents.groupBy("source", named("lang", lang_targets).alias("lang"), named("topic", topic_targets).alias("topic")).agg(F.sum("tokens").cast("double").alias("tokens")),
        "mix-cells",
    )
    kinds = cells.select("lang", "topic").distinct()
    if kinds.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of language and topic: name the languages and topics that have targets of their own")
    grid = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()
    langs, topics = sorted({r["lang"] for r in grid}), sorted({r["topic"] for r in grid})
    place = {(a, b): i for i, (a, b) in enumerate((a, b) for a in langs for b in topics)}
    shape = (len(langs), len(topics))
    have = np.zeros(shape)
    for r in grid:
        have[langs.index(r["lang"]), topics.index(r["topic"])] = r["tokens"]
    total = have.sum()
    if total == 0:
        return Factors(cells.select("source").distinct().withColumn("factor", F.lit(0.0)), langs, topics, np.ones(shape), 0.0, 0)
    by_lang, by_topic = have.sum(axis=1), have.sum(axis=0)
    want_lang = scaled(lang_targets or tempered(dict(zip(langs, by_lang, strict=True)), temper["lang"]), langs, by_lang)
    want_topic = scaled(topic_targets or tempered(dict(zip(topics, by_topic, strict=True)), temper["topic"]), topics, by_topic)
    index = F.element_at(F.create_map(*[x for (a, b), i in place.items() for x in (F.concat_ws("\x01", F.lit(a), F.lit(b)), F.lit(i))]), F.concat_ws("\x01", "lang", "topic"))
    indexed = cells.withColumn("i", index)
    wide = indexed.groupBy("source").agg(F.array(*[F.sum(F.when(F.col("i") == i, F.col("tokens")).otherwise(0.0)) for i in range(len(place))]).alias("t"))
    if source_targets is None:
        raw = F.pow(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), F.lit(temper["source"]))
    else:
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in source_targets.items() for x in kv]), F.col("source")), F.lit(0.0)).cast("double")
    wide = stage(wide.withColumn("raw", F.when(F.exists("t", lambda x: x > 0), raw).otherwise(0.0)), "mix-sources")
    mass = wide.agg(F.sum("raw")).first()[0]
    if not mass:
        raise ValueError("no source with tokens has a target")
    factor_of = lambda b: let_factor(b.ravel(), mass)
    lang_factor, topic_factor = np.ones(len(langs)), np.ones(len(topics))
    error, sweep, errors = np.inf, 0, []
    while True:
        b = lang_factor[:, None] * topic_factor[None, :]
        sums = wide.withColumn("f", factor_of(b)).agg(*[F.sum(F.col("f") * F.get("t", F.lit(i))) for i in range(len(place))]).first()
        m = np.array(list(sums)).reshape(shape) * b
        error = max(np.abs(m.sum(axis=1) - want_lang).max(), np.abs(m.sum(axis=0) - want_topic).max())
        errors.append(error)
        if error < TOLERANCE or (sweep >= STALLED[0] and error >= STALLED[1] * errors[-1 - STALLED[0]]):
            break
        sweep += 1
        step = ratio(want_lang, m.sum(axis=1))
        lang_factor, m = lang_factor * step, m * step[:, None]
        topic_factor = topic_factor * ratio(want_topic, m.sum(axis=0))
    # one weight for every token would be 1
    return Factors(wide.select("source", (factor_of(b) * float(total)).alias("factor")), langs, topics, b, float(error), sweep)


def ratio(want: np.ndarray, have: np.ndarray) -> np.ndarray:
    return np.divide(want, have, out=np.zeros_like(want), where=have > 0)


def let_factor(b: np.ndarray, mass: float) -> Column:
    """A source's factor: its target over its tokens as the grid weighs them now."""
    seen = F.aggregate(F.zip_with("t", F.array(*[F.lit(float(x)) for x in b]), lambda t, x: t * x), F.lit(0.0), lambda a, x: a + x)
    return F.when(seen > 0, F.col("raw") / F.lit(float(mass)) / seen).otherwise(0.0)


def measured(docs: DataFrame, text: str = "text", topic: Column | None = None) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = docs.select(*[c for c in docs.columns if c not in OUTPUT])
    return kept.withColumns({"tokens": F.regexp_count(whole, F.lit(WORD)).cast("long"), "topic": F.coalesce(topic if topic is not None else topic_of(whole), F.lit(NONE))})


def mix(docs: DataFrame, share: float = SHARE, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, most_error: float = MOST_ERROR, **targets) -> DataFrame:
    """``docs`` with ``tokens``, ``topic``, ``weight`` (1 on average over tokens), ``expected`` (copies), ``copies`` (drawn) and ``fit_error``, the largest
    deviation of a language's or topic's share from its target, which is the same in every row."""
    rows = measured(docs, text, topic)
    category = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    factors = fit(rows.select(category(source).alias("source"), category(lang).alias("lang"), "topic", "tokens"), **targets)
    if any(targets.get(f"{k}_targets") for k in TEMPER) and factors.error > most_error:
        raise ValueError(f"the targets contradict each other on these documents: after {factors.sweeps} sweeps a share is off by {factors.error:.3g}")
    named = lambda c, names, targets: c if targets is None else F.when(c.isin(list(targets)), c).otherwise(F.lit(OTHER))
    cell = F.concat_ws("\x01", named(category(lang), factors.langs, targets.get("lang_targets")), named(F.col("topic"), factors.topics, targets.get("topic_targets")))
    pairs = [x for i, a in enumerate(factors.langs) for j, b in enumerate(factors.topics) for x in (F.concat_ws("\x01", F.lit(a), F.lit(b)), F.lit(float(factors.grid[i, j])))]
    in_grid = F.element_at(F.create_map(*pairs), cell) if pairs else F.lit(0.0)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(20), F.col(doc_id), F.col(text)), 11) / F.lit(float(1 << 53))
    by, factor = unused(rows.columns, "by"), unused(rows.columns, "factor")
    joined = rows.withColumn(by, category(source)).join(factors.sources.select(F.col("source").alias(by), F.col("factor").alias(factor)), by, "left")
    weighed = joined.withColumn("weight", F.coalesce(F.col(factor) * in_grid, F.lit(0.0))).withColumn("expected", F.col("weight") * share)
    drawn_copies = (F.floor("expected") + (drawn < F.col("expected") - F.floor("expected")).cast("long")).cast("long")
    return weighed.withColumn("copies", drawn_copies).drop(by, factor).withColumn("fit_error", F.lit(float(factors.error)))
