"""Secret scan: three fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Columns only: a map over the rows with no shuffle and no Python. A text is first cut into segments of about ``SEGMENT`` characters, at places that no match of any
pattern can span; positions inside a segment come from splitting it at the matches and adding up lengths. So the work grows with the text and not with its square
(a longer run without such a place is one segment: there the matches inside it count twice over). A candidate is a maximal run of ``CANDIDATE``; a window of ``WINDOW`` characters slides
over it with one character count per code kept up to date, one added and one taken away per step. The sum of c*log2(c) over the counts
is carried as whole numbers, so that every engine gets the same decision. Windows of hexadecimal characters and mixed windows have
their own least entropy; windows above it that touch are one span. Allow-listed candidates and spans inside a pattern's span are left out.

A ``thorough`` scan, the default, has two more classes, windows of lower-case letters and digits alone and of upper-case letters and digits alone
(base36 and base32), and an allow-list match inside a candidate silences the windows that overlap it and no others; a pattern that begins with
``^`` and an allowed value still speak for the whole candidate.

Defined results: a null text counts as empty; repeated rows are scanned alike; of spans with equal start the kinds go in the order of ``KINDS``,
then the shorter first. Texts are scanned whole. Columns of the input are kept; one named like an output column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .tasks import let, unused

# Fixed patterns of the result's definition: kind, expression, group that is measured, least length of it.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
THOROUGH_KINDS = (*KINDS, "entropy_lower", "entropy_upper")
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{WINDOW},}}"
SCALE = 1 << 20
LEAST_BITS = {"entropy_hex": 2.9, "entropy_mixed": 3.7, "entropy_lower": 3.4, "entropy_upper": 3.4}
ALLOWED = (
    r"(?i)example|dummy|placeholder|changeme",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^sha(256|384|512)-",
    r"(?i)abcdefghijklmnop|0123456789abcdef",
)
CODES = 123  # up to 'z'
SEGMENT = 1024
# Where no match goes on: before a character of none of the patterns, and before a space that is no part of an assignment.
CUT = r"""(?=[^A-Za-z0-9+/_.=:"'\x20-]|(?<![:=\x20])\x20[^:=\x20])"""
ANYTHING = rf"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|[A-Za-z0-9+/_-]{{{WINDOW},}}"
SPAN = "STRUCT<start: INT, rank: INT, stop: INT>"


def weights(window: int = WINDOW) -> list[int]:
    """c*log2(c) for counts 0 to the window, in whole steps of 1/``SCALE``."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def most_weight(bits: float, window: int = WINDOW) -> int:
    """Entropy = log2(window) - sum/window, so at least ``bits`` means at most this sum."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def starts_of(gaps: Column, lengths: Column) -> Column:
    """Start of each match, from the lengths of the texts between matches and of the matches."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(lengths)).alias("g"), lengths.alias("n")), begin,
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out")),
    )["out"]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of struct(start, text, value) of all matches, left to right without overlap."""
    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("text"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    return let(found, lambda f: F.arrays_zip(starts_of(f["gaps"], F.transform(f["text"], F.length)).alias("start"), f["text"].alias("text"), f["value"].alias("value")))


def segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SEGMENT}}}(?:.*?{CUT}|.*)"), F.lit(0))


def by_segments(text: Column, spans: Callable[[Column], Column]) -> Column:
    """``spans`` of each segment of the text, moved to where the segment begins."""

    def moved(parts: Column) -> Column:
        begins = starts_of(F.array_repeat(F.lit(0), F.size(parts)), F.transform(parts, F.length))
        found = F.zip_with(parts, begins, lambda part, at: F.transform(spans(part), lambda m: F.struct((m["start"] + at).alias("start"), m["rank"].alias("rank"), (m["stop"] + at).alias("stop"))))
        return F.flatten(found)

    return let(segments(text), moved)


def pattern_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    fits = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    spans = F.transform(fits, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["text"])).alias("stop")))
    # Patterns of one run of characters can't hold a match where the least run is nowhere.
    quick = pattern if group else pattern.removesuffix("+") + f"{{{least - len(pattern.partition('[')[0])}}}"
    return F.when(text.rlike(quick), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_spans(value: Column, start: Column, window: int = WINDOW, silenced: Sequence[str] | None = None) -> Column:
    """Spans of the candidate ``value`` whose windows have enough entropy, by counts kept up to date. With ``silenced`` the scan
    is thorough, and windows that overlap a match of one of these patterns don't count."""
    thorough = silenced is not None
    table = F.array(*[F.lit(w) for w in weights(window)])
    empty = F.array().cast(f"array<{SPAN}>")
    hex_most, mixed_most = (most_weight(LEAST_BITS[k], window) for k in ("entropy_hex", "entropy_mixed"))

    def within(code: Column, a: str, b: str) -> Column:
        return ((code >= ord(a)) & (code <= ord(b))).cast("int")

    def grown(spans: Column, rank: int, at: Column, hit: Column) -> Column:
        """The spans with the window ending before ``at`` joined to the last one or put after it."""
        low = at - F.lit(window)
        joins = (F.size(spans) > 0) & (F.element_at(F.concat(spans, F.array(F.struct(F.lit(0).alias("start"), F.lit(rank).alias("rank"), F.lit(-1).alias("stop")))), F.greatest(F.size(spans), F.lit(1)))["stop"] >= low)
        last = F.element_at(spans, -1)
        span = lambda a: F.array(F.struct(a.alias("start"), F.lit(rank).alias("rank"), at.alias("stop")))
        return F.when(~hit, spans).when(joins, F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), span(last["start"]))).otherwise(F.concat(spans, span(low)))

    def scan(codes: Column, quiet: Column | None = None) -> Column:
        more = {"l": "entropy_lower", "u": "entropy_upper"} if thorough else {}
        begin = F.struct(
            F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("upper"),
            F.lit(0).alias("lower"), F.lit(0).alias("hex"), empty.alias("h"), empty.alias("m"), *[empty.alias(k) for k in more], F.lit(0).alias("at"),
        )

        def step(acc: Column, code: Column) -> Column:
            gone = F.when(acc["at"] >= window, F.get(codes, acc["at"] - window)).otherwise(F.lit(-1))
            into, out = F.get(acc["counts"], code), F.coalesce(F.get(acc["counts"], gone), F.lit(0))
            change = F.get(table, into + 1) - F.get(table, into) + F.when(gone >= 0, F.get(table, out - 1) - F.get(table, out)).otherwise(0)
            is_hex = lambda c: within(c, "0", "9") + within(c, "a", "f") + within(c, "A", "F")
            moved = lambda f: f(code) - f(gone)
            return let(
                F.struct(
                    F.transform(acc["counts"], lambda c, k: c + (k == code).cast("int") - (k == gone).cast("int")).alias("counts"),
                    (acc["sum"] + F.when(code == gone, 0).otherwise(change)).alias("sum"),
                    (acc["digits"] + moved(lambda c: within(c, "0", "9"))).alias("digits"), (acc["upper"] + moved(lambda c: within(c, "A", "Z"))).alias("upper"),
                    (acc["lower"] + moved(lambda c: within(c, "a", "z"))).alias("lower"), (acc["hex"] + moved(is_hex)).alias("hex"),
                    acc["h"].alias("h"), acc["m"].alias("m"), *[acc[k].alias(k) for k in more], (acc["at"] + 1).alias("at"),
                ),
                lambda s: with_more(s, s.withField("h", grown(s["h"], KINDS.index("entropy_hex"), s["at"], full(s) & (s["hex"] == window) & (s["upper"] + s["lower"] > 0) & (s["sum"] <= hex_most)))
                .withField("m", grown(s["m"], KINDS.index("entropy_mixed"), s["at"], full(s) & (s["hex"] < window) & (s["upper"] > 0) & (s["lower"] > 0) & (s["sum"] <= mixed_most)))),
            )

        def with_more(old: Column, new: Column) -> Column:
            for k, kind in more.items():
                one = old["lower" if k == "l" else "upper"]
                hit = full(old) & (old["hex"] < window) & (one > 0) & (old["digits"] + one == window) & (old["sum"] <= most_weight(LEAST_BITS[kind], window))
                new = new.withField(k, grown(old[k], THOROUGH_KINDS.index(kind), old["at"], hit))
            return new

        def full(s: Column) -> Column:
            whole = (s["at"] >= window) & (s["digits"] > 0)
            return whole if quiet is None else whole & ~F.exists(quiet, lambda q: (q["start"] < s["at"]) & (q["stop"] > s["at"] - window))

        return let(F.aggregate(codes, begin, step), lambda s: F.concat(s["h"], s["m"], *[s[k] for k in more]))

    codes = F.transform(F.split(value, ""), F.ascii)
    if silenced:
        # every pattern by itself, so that a match of one can't hide that of another
        quiet = F.concat(*[F.transform(matches(value, p), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("stop"))) for p in silenced])
        found = let(F.struct(codes.alias("codes"), quiet.alias("quiet")), lambda x: scan(x["codes"], x["quiet"]))
    else:
        found = let(codes, lambda c: scan(c))
    return F.transform(found, lambda s: F.struct((s["start"] + start).alias("start"), s["rank"].alias("rank"), (s["stop"] + start).alias("stop")))


def entropy_spans(text: Column, allowed: Sequence[str] = ALLOWED, allowed_values: Sequence[str] = (), thorough: bool = False) -> Column:
    silenced = [p for p in allowed if not re.match(r"(\(\?\w+\))?\^", p)] if thorough else []

    def suspicious(m: Column) -> Column:
        ok = m["text"].rlike("[0-9]") & m["text"].rlike("[A-Za-z]")
        for pattern in (p for p in allowed if p not in silenced):
            ok = ok & ~m["text"].rlike(pattern)
        return ok & ~m["text"].isin(list(allowed_values)) if allowed_values else ok

    candidates = F.filter(matches(text, CANDIDATE), suspicious)
    spans = F.flatten(F.transform(candidates, lambda m: window_spans(m["text"], m["start"], silenced=silenced if thorough else None)))
    return F.when(text.rlike(CANDIDATE.replace(",}", "}")), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def part_spans(part: Column, allowed: Sequence[str], allowed_values: Sequence[str], thorough: bool) -> Column:
    """Spans of the patterns in a segment, and those of the entropy windows that lie in none of them, in order."""
    base = F.concat(*[pattern_spans(part, *p) for p in PATTERNS])
    more = entropy_spans(part, allowed, allowed_values, thorough)
    free = lambda x: F.filter(x["more"], lambda m: ~F.exists(x["base"], lambda b: (b["start"] <= m["start"]) & (b["stop"] >= m["stop"])))
    return F.array_sort(let(F.struct(base.alias("base"), more.alias("more")), lambda x: F.concat(x["base"], free(x))))


def scan(docs: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED, allowed_values: Sequence[str] = (), thorough: bool = True) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of struct(start, rank in ``THOROUGH_KINDS``, stop) in order, code points, end exclusive."""
    kept = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    whole = F.coalesce(F.col(text), F.lit(""))
    found = by_segments(whole, lambda part: part_spans(part, allowed, allowed_values, thorough))
    # Texts that hold nothing a pattern could begin with, most of all, aren't cut.
    spans = F.when(whole.rlike(ANYTHING), found).otherwise(F.array().cast(f"array<{SPAN}>"))
    both = let(spans, lambda x: F.struct(F.filter(x, lambda m: m["rank"] < len(PATTERNS)).alias("base_spans"), x.alias("all_spans")))
    held = unused(docs.columns, "spans")
    return docs.withColumn(held, both).select(*kept, f"{held}.base_spans", f"{held}.all_spans")


def masked(text: Column, allowed: Sequence[str] = ALLOWED, allowed_values: Sequence[str] = (), thorough: bool = True, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``, segment by segment: no span goes on over a cut. A null stays null."""
    clean = lambda part: let(F.struct(part.alias("part"), part_spans(part, allowed, allowed_values, thorough).alias("spans")), lambda x: redacted(x["part"], x["spans"], mark))
    return F.when(text.rlike(ANYTHING), F.array_join(F.transform(segments(text), clean), "")).otherwise(text)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in THOROUGH_KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap or touch are one."""
    begin = F.array().cast(f"array<{SPAN}>")

    def joined(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(F.size(acc) == 0, F.array(s)).when(
            last["stop"] >= s["start"],
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(s)))

    def cut(merged: Column) -> Column:
        before = lambda s, i: F.when(i == 0, 0).otherwise(F.get(merged, i - 1)["stop"])
        parts = F.transform(merged, lambda s, i: F.concat(F.substring(text, before(s, i) + 1, s["start"] - before(s, i)), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(merged, -1)["stop"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.aggregate(spans, begin, joined), cut)).otherwise(text)
