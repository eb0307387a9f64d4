"""Small numeric kernels over one frame's aggregates: all array or scalar expressions.

``entries`` is an array of ``STRUCT<bin: INT, n: BIGINT>`` sorted by bin with one
entry per non-empty bin, so its length is bounded by the number of bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .transfer import FINE_BINS, col, clamp, pq_to_nits

# Fixed values of the grain estimator.
DIFF_BANDS = 16
DIFF_BINS = 64
MIN_GRAIN_PAIRS = 500
BAND_PERCENTILE = 99.5
FLOOR_PERCENTILE = 99.99
FLOOR_Z = 3.719016485455709
EXACTNESS_GATE = 0.25 / 4095.0
MAD_TO_SIGMA = 0.6745
MAX_CORRECTION_SIGMAS = 4.0
# Fixed coefficients of the Abramowitz-Stegun normal tail.
SURVIVAL_T = 0.2316419
SURVIVAL_COEFFICIENTS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

NO_KNEE_NITS = 1000.0


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a lambda re-evaluates what it captures."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total_count(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])


def _first_bin_over(entries: Column, ignored: Column) -> Column:
    """Bin of the first entry whose running count exceeds ``ignored``; null if none does."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bin"))
    return F.aggregate(
        entries,
        start,
        lambda acc, e: F.struct(
            (acc["seen"] + e["n"]).alias("seen"),
            F.coalesce(
                acc["bin"], F.when(acc["seen"] + e["n"] > ignored, e["bin"])
            ).alias("bin"),
        ),
        lambda acc: acc["bin"],
    )


def low_percentile_bin(entries: Column, percentile: float) -> Column:
    share = min(max(percentile, 0.0), 100.0) / 100.0
    ignored = F.floor(F.lit(share) * total_count(entries).cast("double"))
    found = let(ignored, lambda skip: _first_bin_over(entries, skip))
    return F.coalesce(found, F.element_at(entries, -1)["bin"])


def high_percentile_bin(entries: Column, percentile: float) -> Column:
    share = (100.0 - min(max(percentile, 0.0), 100.0)) / 100.0
    ignored = F.floor(F.lit(share) * total_count(entries).cast("double"))
    found = let(ignored, lambda skip: _first_bin_over(F.reverse(entries), skip))
    return F.coalesce(found, F.element_at(entries, 1)["bin"])


def _bin_to_pq(bin_: Column, bins: int) -> Column:
    return F.coalesce(bin_ / F.lit(float(bins - 1)), F.lit(0.0))


def low_percentile_pq(entries: Column, percentile: float, bins: int = FINE_BINS) -> Column:
    return F.when(F.size(entries) > 0, _bin_to_pq(low_percentile_bin(entries, percentile), bins)).otherwise(0.0)


def high_percentile_pq(entries: Column, percentile: float, bins: int = FINE_BINS) -> Column:
    return F.when(F.size(entries) > 0, _bin_to_pq(high_percentile_bin(entries, percentile), bins)).otherwise(0.0)


def _top_down_bin(hist: Column, target: float) -> Column:
    """Highest index of a dense percent histogram with at least ``target`` percent at or above it."""
    start = F.struct(
        F.lit(0.0).alias("seen"), (F.size(hist) - 1).alias("at"), F.lit(None).cast("int").alias("bin")
    )
    return F.aggregate(
        F.reverse(hist),
        start,
        lambda acc, share: F.struct(
            (acc["seen"] + share).alias("seen"),
            (acc["at"] - 1).alias("at"),
            F.coalesce(acc["bin"], F.when(acc["seen"] + share >= target, acc["at"])).alias("bin"),
        ),
        lambda acc: acc["bin"],
    )


def lum_percentile_pq(hist: Column, percentile: float) -> Column:
    """Upper percentile of a dense percent histogram, read back as bin / 255."""
    top = F.size(hist) - F.array_position(
        F.transform(F.reverse(hist), lambda share: share > 0), F.lit(True)
    ).cast("int")
    non_empty = F.when(F.exists(hist, lambda share: share > 0), top)
    bin_ = F.coalesce(_top_down_bin(hist, 100.0 - percentile), non_empty)
    return F.coalesce(bin_ / F.lit(255.0), F.lit(1.0))


def highlight_knee_nits(hist: Column) -> Column:
    bin_ = _top_down_bin(hist, 1.0)
    return F.coalesce(pq_to_nits(bin_ / F.lit(255.0)), F.lit(NO_KNEE_NITS))


def select_peak_pq(hist: Column, direct: Column, source: str) -> Column:
    if source == "histogram99":
        return lum_percentile_pq(hist, 99.0)
    if source == "histogram999":
        return lum_percentile_pq(hist, 99.9)
    return direct


def mean_from_hist(hist: Column) -> Column:
    state = F.aggregate(
        hist,
        F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("weighted"), F.lit(0.0).alias("weight")),
        lambda acc, share: F.struct(
            (acc["at"] + 1).alias("at"),
            (acc["weighted"] + F.when(share > 0, acc["at"] / F.lit(255.0) * share).otherwise(0.0)).alias("weighted"),
            (acc["weight"] + F.when(share > 0, share).otherwise(0.0)).alias("weight"),
        ),
    )
    return F.when(state["weight"] > 0, state["weighted"] / state["weight"]).otherwise(0.0)


def chi_square(left: Column, right: Column) -> Column:
    """Symmetric chi-square distance of two percent histograms."""
    terms = F.zip_with(left, right, lambda a, b: (a - b) * (a - b) / (a + b + F.lit(1e-6)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)


def expected_gaussian_max(n: Column) -> Column:
    log_n = F.log(n.cast("double"))
    lead = F.sqrt(F.lit(2.0) * log_n)
    value = lead - (F.log(log_n) + F.lit(math.log(4.0 * math.pi))) / (F.lit(2.0) * lead)
    return F.when(n <= 1, F.lit(0.0)).otherwise(value)


def normal_survival(z: Column) -> Column:
    x = F.greatest(z, F.lit(0.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(SURVIVAL_T) * x)
    polynomial = F.lit(0.0)
    for coefficient in reversed(SURVIVAL_COEFFICIENTS):
        polynomial = t * (F.lit(coefficient) + polynomial)
    return polynomial * F.exp(F.lit(-0.5) * x * x) / F.lit(math.sqrt(2.0 * math.pi))


def _predicted_tail(support: Column) -> Column:
    threshold = F.greatest(expected_gaussian_max(support) - 2.0, F.lit(0.0))
    return support.cast("double") * let(threshold, normal_survival)


def support_count(tail: Column, total: Column) -> Column:
    """Smallest support in [max(tail, 2), total] whose predicted tail reaches ``tail``.

    An integer bisection of a 63-bit range needs at most 63 halvings; a step on a
    closed interval changes nothing.
    """
    low = F.greatest(tail, F.lit(2)).cast("bigint")
    high = F.greatest(total, low).cast("bigint")

    def halve(state: Column, _step: Column) -> Column:
        mid = state["low"] + F.shiftright(state["high"] - state["low"], 1)
        is_open = state["low"] < state["high"]
        short = _predicted_tail(mid) < tail.cast("double")
        return F.struct(
            F.when(is_open & short, mid + 1).otherwise(state["low"]).alias("low"),
            F.when(is_open & ~short, mid).otherwise(state["high"]).alias("high"),
        )

    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(63)),
        F.struct(low.alias("low"), high.alias("high")),
        halve,
        lambda state: state["low"],
    )
    return F.when(tail <= 1, tail.cast("bigint")).otherwise(found)


def effective_tail(entries: Column, raw_max: Column, sigma: Column) -> Column:
    threshold = F.round(clamp(F.greatest(raw_max - 2.0 * sigma, F.lit(0.0)), 0.0, 1.0) * (FINE_BINS - 1))
    return let(threshold, lambda low: total_count(F.filter(entries, lambda e: e["bin"] >= low)))


def grain_sigma(pairs: Column, entries: Column) -> Column:
    """Noise level from site-to-site differences.

    ``pairs`` is an array of ``STRUCT<band: INT, diff: INT, n: BIGINT>`` sorted by
    (band, diff). From the band of P99.5 downward, the first band that holds enough
    pairs together with the band below it decides.
    """
    peak_bin = F.when(F.size(entries) > 0, high_percentile_bin(entries, BAND_PERCENTILE)).otherwise(0)
    peak_band = F.least(F.shiftright(peak_bin, 8), F.lit(DIFF_BANDS - 1))

    def in_band(band: Column) -> Column:
        return F.filter(pairs, lambda p: (p["band"] == band) | (p["band"] == band - 1))

    def median_of(chosen: Column) -> Column:
        by_diff = F.transform(
            F.sequence(F.lit(0), F.lit(DIFF_BINS - 1)),
            lambda d: F.struct(
                d.alias("bin"), total_count(F.filter(chosen, lambda p: p["diff"] == d)).alias("n")
            ),
        )
        below_median = F.floor((total_count(chosen) + 1) / 2) - 1
        return let(below_median, lambda skip: _first_bin_over(by_diff, skip))

    bands = F.sequence(peak_band, F.lit(0), F.lit(-1))
    usable = F.filter(bands, lambda band: total_count(in_band(band)) >= MIN_GRAIN_PAIRS)
    # The first usable band wins; slicing keeps the empty case an empty array.
    medians = F.transform(F.slice(usable, 1, 1), lambda band: let(in_band(band), median_of))
    sigma = F.get(medians, 0) / F.lit(math.sqrt(2.0) * MAD_TO_SIGMA) / F.lit(float(FINE_BINS - 1))
    return F.coalesce(sigma, F.lit(0.0))


def robust_peak(entries: Column, raw_max: Column, sigma: Column) -> Column:
    """Raw extreme corrected for measurable grain, never below the shifted P99.99."""
    tail = effective_tail(entries, raw_max, sigma)
    support = let(
        F.struct(tail.alias("tail"), total_count(entries).alias("total")),
        lambda c: support_count(c["tail"], c["total"]),
    )
    expected = expected_gaussian_max(support)
    correction = F.least(sigma * expected, F.lit(MAX_CORRECTION_SIGMAS) * sigma)
    floor_ = F.greatest(high_percentile_pq(entries, FLOOR_PERCENTILE) - F.lit(FLOOR_Z) * sigma, F.lit(0.0))
    corrected = F.least(F.greatest(raw_max - correction, F.least(floor_, raw_max)), raw_max)
    return F.when((sigma < EXACTNESS_GATE) | (tail <= 1), raw_max).otherwise(corrected)


def entries_from_counts(values: Column) -> Column:
    """Entries of a dense count array, for histograms that arrive dense."""
    indexed = F.transform(values, lambda n, i: F.struct(i.alias("bin"), col(n).cast("bigint").alias("n")))
    return F.filter(indexed, lambda e: e["n"] > 0)
