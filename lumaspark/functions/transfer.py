"""Transfer curves, code values and bin numbers (per row; the only UDFs are the curves in the C library's bits)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Fixed values of SMPTE ST 2084.
PEAK_NITS = 10000.0
M1 = 2610.0 / 16384.0
M2 = 2523.0 / 4096.0 * 128.0
C1 = 3424.0 / 4096.0
C2 = 2413.0 / 4096.0 * 32.0
C3 = 2392.0 / 4096.0 * 32.0
# Fixed values of the ITU-R BT.2100 HLG curve.
HLG_A = 0.17883277
HLG_B = 0.28466892
HLG_C = 0.55991073
# Fixed values of 10-bit limited range.
BLACK_CODE = 64
LUMA_RANGE = 876.0
NEUTRAL_CHROMA = 512
CHROMA_RANGE = 896.0
# Fixed bin counts.
LUM_BINS = 256
SDR_BINS = 64
HUE_BINS = 31
FINE_BINS = 4096
MIN_CHROMA_MAGNITUDE = 10.0
NON_BLACK_LEVEL = 0.01
DEFAULT_HLG_PEAK = 1000.0


def col(value) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def nits_to_pq(nits) -> Column:
    y = F.pow(F.greatest(col(nits) / F.lit(PEAK_NITS), F.lit(0.0)), F.lit(M1))
    return F.pow((F.lit(C1) + F.lit(C2) * y) / (F.lit(1.0) + F.lit(C3) * y), F.lit(M2))


def pq_to_nits(pq) -> Column:
    value = col(pq)
    e = F.pow(value, F.lit(1.0 / M2))
    linear = F.greatest(e - F.lit(C1), F.lit(0.0)) / (F.lit(C2) - F.lit(C3) * e)
    return F.when(value <= 0, F.lit(0.0)).otherwise(F.pow(linear, F.lit(1.0 / M1)) * F.lit(PEAK_NITS))


def nits_to_pq_number(nits: float) -> float:
    """Driver-side value of :func:`nits_to_pq`, for constants in expressions."""
    y = max(nits / PEAK_NITS, 0.0) ** M1
    return ((C1 + C2 * y) / (1.0 + C3 * y)) ** M2


def pq_to_nits_number(pq: float) -> float:
    """One value of :func:`pq_to_nits`."""
    if pq <= 0:
        return 0.0
    e = pq ** (1.0 / M2)
    above, below = max(e - C1, 0.0), C2 - C3 * e
    if below <= 0:
        return math.nan if below < 0 else math.inf
    return (above / below) ** (1.0 / M1) * PEAK_NITS


SDR_PEAK_PQ = nits_to_pq_number(100.0)


def _each(function, column: pa.Array) -> pa.Array:
    values = [function(v) for v in column.to_numpy(zero_copy_only=False).tolist()]
    return pa.array(np.array(values, "float64"), mask=column.is_null().to_numpy(zero_copy_only=False))


# Python's power of floats is the C library's. Spark's differs from it in the last bit of some values, and
# where nits come back from PQ to be cut to whole numbers, the last bit decides over a nit.
# The UDFs are made per call: one kept in the module would go with it into the tasks of other functions.
def _c_nits_to_pq(nits: pa.Array) -> pa.Array:
    return _each(nits_to_pq_number, nits)


def _c_pq_to_nits(pq: pa.Array) -> pa.Array:
    return _each(pq_to_nits_number, pq)


def c_nits_to_pq(nits) -> Column:
    """:func:`nits_to_pq` in the bits of the C library, for values that end as whole nits."""
    return F.arrow_udf(_c_nits_to_pq, DoubleType())(F.coalesce(col(nits).cast("double"), F.lit(0.0)))


def c_pq_to_nits(pq) -> Column:
    """:func:`pq_to_nits` in the bits of the C library, for frames and scenes whose nits are cut to whole numbers."""
    return F.arrow_udf(_c_pq_to_nits, DoubleType())(col(pq).cast("double"))


def nits_to_pq_code(nits) -> Column:
    return F.round(nits_to_pq(clamp(col(nits).cast("double"), 0.0, PEAK_NITS)) * 4095).cast("int")


def hlg_relative(signal) -> Column:
    s = clamp(col(signal), 0.0, 1.0)
    return F.when(s <= 0.5, s * s / F.lit(3.0)).otherwise(
        (F.exp((s - F.lit(HLG_C)) / F.lit(HLG_A)) + F.lit(HLG_B)) / F.lit(12.0)
    )


def hlg_to_nits(signal, peak_nits=DEFAULT_HLG_PEAK) -> Column:
    return F.least(hlg_relative(signal) * col(peak_nits), F.lit(PEAK_NITS))


def luma_signal(y_code) -> Column:
    """Unclamped signal of a limited-range luma code."""
    return (col(y_code) - F.lit(BLACK_CODE)) / F.lit(LUMA_RANGE)


def _by_transfer(transfer, when_hlg, otherwise: Column) -> Column:
    # A plain string prunes the other branch before planning.
    if isinstance(transfer, str):
        return when_hlg() if transfer == "HLG" else otherwise
    return F.when(transfer == "HLG", when_hlg()).otherwise(otherwise)


def luma_pq(y_code, transfer="PQ", hlg_peak=DEFAULT_HLG_PEAK) -> Column:
    signal = luma_signal(y_code)
    value = _by_transfer(transfer, lambda: nits_to_pq(hlg_to_nits(signal, hlg_peak)), signal)
    return clamp(value, 0.0, 1.0)


def max_rgb_pq(y_code, cb_code, cr_code, transfer="PQ", hlg_peak=DEFAULT_HLG_PEAK) -> Column:
    """Largest BT.2020 component; red, green and blue come from the unclamped luma."""
    luma = luma_signal(y_code)
    cb = (col(cb_code) - F.lit(NEUTRAL_CHROMA)) / F.lit(CHROMA_RANGE)
    cr = (col(cr_code) - F.lit(NEUTRAL_CHROMA)) / F.lit(CHROMA_RANGE)
    red = luma + F.lit(1.4746) * cr
    blue = luma + F.lit(1.8814) * cb
    green = (luma - F.lit(0.2627) * red - F.lit(0.0593) * blue) / F.lit(0.6780)
    peak = clamp(F.greatest(red, green, blue), 0.0, 1.0)
    return _by_transfer(transfer, lambda: luma_pq(y_code, "HLG", hlg_peak), peak)


def pq12(pq) -> Column:
    return F.round(clamp(col(pq), 0.0, 1.0) * 4095).cast("int")


def fine_bin(pq) -> Column:
    return F.round(clamp(col(pq), 0.0, 1.0) * (FINE_BINS - 1)).cast("int")


def lum_bin(pq) -> Column:
    """64 bins up to 100 nits, 192 above them."""
    value = col(pq)
    low_step = SDR_PEAK_PQ / SDR_BINS
    high_step = (1.0 - SDR_PEAK_PQ) / (LUM_BINS - SDR_BINS)
    low = F.floor(value / F.lit(low_step))
    high = F.lit(SDR_BINS) + F.floor((value - F.lit(SDR_PEAK_PQ)) / F.lit(high_step))
    return F.least(F.when(value < SDR_PEAK_PQ, low).otherwise(high), F.lit(LUM_BINS - 1)).cast("int")


def hue_bin(cb_code, cr_code) -> Column:
    """Hue sector, null where the chroma is too weak to have a hue."""
    u = (col(cb_code) - NEUTRAL_CHROMA).cast("double")
    v = (col(cr_code) - NEUTRAL_CHROMA).cast("double")
    degrees = F.pmod(F.degrees(F.atan2(v, u)) + 360.0, F.lit(360.0))
    sector = F.least(F.floor(degrees * HUE_BINS / 360.0), F.lit(HUE_BINS - 1)).cast("int")
    return F.when(F.sqrt(u * u + v * v) >= MIN_CHROMA_MAGNITUDE, sector)


def is_non_black(y_code) -> Column:
    return clamp(luma_signal(y_code), 0.0, 1.0) > NON_BLACK_LEVEL


def gamut_peaks(peak_pq) -> tuple[Column, Column]:
    """Approximate P3 and BT.709 peaks of a BT.2020 peak."""
    return (
        F.least(col(peak_pq) * F.lit(0.99), F.lit(1.0)),
        F.least(col(peak_pq) * F.lit(0.95), F.lit(1.0)),
    )


def full_range_pq(y_code) -> Column:
    return col(y_code) / F.lit(1023.0)


def full_range_bin(y_code) -> Column:
    return F.least(F.round(full_range_pq(y_code) * 255), F.lit(255.0)).cast("int")


# Fixed names of the transfer tags.
PQ_TAGS = ("smpte2084", "bt2020-10", "bt2020-12")
HLG_TAGS = ("arib-std-b67",)


def transfer_of(tag) -> Column:
    value = F.lower(col(tag))
    return (
        F.when(value.isin(*PQ_TAGS), "PQ").when(value.isin(*HLG_TAGS), "HLG").otherwise("unknown")
    )


def unpack_code(raw, layout: str = "planar") -> Column:
    """10-bit code of a 16-bit word: low bits when planar, high bits when packed as P010."""
    word = col(raw)
    if layout == "p010":
        word = F.shiftright(word, 6)
    elif layout != "planar":
        raise ValueError(f"unknown layout {layout!r}")
    return word.bitwiseAND(1023)


def sdr_step() -> float:
    return SDR_PEAK_PQ / SDR_BINS


def log10_or_inf(value: float) -> float:
    """``-log10(value)``, infinite at zero."""
    return math.inf if value <= 0 else -math.log10(value)
