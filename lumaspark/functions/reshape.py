"""Fixed-point reshaping of base-layer samples and the residual (exact 64-bit integers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .transfer import clamp, col

CONTAINER_SHIFT = 6  # 10-bit codes sit in the high bits of 16-bit words
MOST_PIECES = 8  # of a curve, by the format
NEUTRAL_CHROMA_16 = 512 << CONTAINER_SHIFT


def big(value) -> Column:
    return col(value).cast("bigint")


def shift_left(value: Column, bits: Column) -> Column:
    """``value * 2 ** bits`` for a column of shift counts."""
    return F.call_function("shiftleft", value.cast("bigint"), bits.cast("int"))


def shift_right(value: Column, bits: Column) -> Column:
    """Arithmetic shift; rounds toward minus infinity."""
    return F.call_function("shiftright", value.cast("bigint"), bits.cast("int"))


def piece_for(x10: Column, curve: Column) -> Column:
    """First piece whose upper pivot lies above ``x10``, else the last piece.

    The pivots are compared one by one as flat values, which stays within generated code; a curve of more pieces than the format has fails.
    """
    pieces, pivots = curve["pieces"], curve["pivots"]
    last = F.size(pieces) - 1
    at = F.when(last >= MOST_PIECES, F.raise_error(F.lit(f"a curve has more than {MOST_PIECES} pieces")).cast("int"))
    for i in range(MOST_PIECES):
        at = at.when((last > i) & (x10 < F.get(pivots, i + 1)), i)
    return F.get(pieces, at.otherwise(last))


def to_container(fixed: Column, denom: Column) -> Column:
    """Fixed point to a 16-bit container value, clamped."""
    code = shift_right(fixed, denom)
    return clamp(F.call_function("shiftleft", code, F.lit(CONTAINER_SHIFT)), 0, 65535).cast("bigint")


def coefficient(coefs: Column, i: int) -> Column:
    return F.coalesce(F.get(coefs, i), F.lit(0).cast("bigint"))


def poly_reshape(x16: Column, curve: Column, denom: Column) -> Column:
    """Piecewise polynomial: c0 + c1 x (+ c2 x^2 where the piece's order is at least 1)."""
    x = F.shiftright(big(x16), CONTAINER_SHIFT)
    piece = piece_for(x, curve)
    c0, c1, c2 = (coefficient(F.get(piece["coefs"], 0), i) for i in range(3))
    quadratic = F.when(piece["ord"] >= 1, c2 * x * x).otherwise(F.lit(0).cast("bigint"))
    active = (curve["kind"] == "polynomial") & (F.size(curve["pieces"]) > 0)
    return F.when(active, to_container(c0 + c1 * x + quadratic, denom)).otherwise(big(x16))


def with_mmr(df: DataFrame, y16: Column, cb16: Column, cr16: Column, curve: Column, denom: Column, out: str) -> DataFrame:
    """Adds ``out``: multi-channel regression in up to three orders of luma and chroma terms.

    Codes, piece, powers and the sum of each order are columns of their own, one projection after the other, so each is worked out once per sample and all of it in
    generated code.
    """
    at = lambda name: f"_{out}_{name}"
    codes = {n: F.shiftright(big(v), CONTAINER_SHIFT) for n, v in (("y", y16), ("cb", cb16), ("cr", cr16))}
    step = df.withColumns({at(n): v for n, v in codes.items()} | {at("denom"): denom.cast("int"), at("curve"): curve, at("else"): big(cb16)})
    down = lambda value: shift_right(value, F.col(at("denom")))
    squares = {at(f"{n}2"): down(F.col(at(n)) * F.col(at(n))) for n in codes}
    step = step.withColumns({at("piece"): piece_for(F.col(at("y")), F.col(at("curve")))} | squares)
    piece, (y, cb, cr) = F.col(at("piece")), (F.col(at(n)) for n in codes)
    # Held as columns: looked up in the piece at each use, they would make a method too long to be compiled.
    none = F.array().cast("array<bigint>")
    found = {order: F.coalesce(F.get(piece["coefs"], order - 1), none) for order in (1, 2, 3)}
    orders = {at(f"k{order}"): v if order == 1 else F.when(piece["ord"] >= order, v).otherwise(none) for order, v in found.items()}
    step = step.withColumns(orders | {at(f"{n}3"): down(F.col(at(f"{n}2")) * F.col(at(n))) for n in codes})
    powers = {order: [F.col(at(n if order == 1 else f"{n}{order}")) for n in codes] for order in (1, 2, 3)}

    def terms(order: int) -> Column:
        """Seven terms of one order: its luma and chroma powers, their products with the codes, and a last one. An order that isn't there has no coefficients and adds 0."""
        coefs = F.col(at(f"k{order}"))
        k = [coefficient(coefs, i) for i in range(7)]
        a, b, c = powers[order]
        linear = k[0] * a + k[1] * b + k[2] * c
        cross = down(k[3] * a) * cb + down(k[4] * a) * cr + down(k[5] * b) * cr
        last = down(down(k[6] * a) * cb * cr) if order == 1 else down(down(k[6] * a) * b)
        return linear + cross + last

    sums = [at(f"sum{order}") for order in powers]
    step = step.withColumns({name: terms(order) for name, order in zip(sums, powers, strict=True)})
    active = (F.col(at("curve"))["kind"] == "mmr") & (F.size(F.col(at("curve"))["pieces"]) > 0)
    value = to_container(piece["constant"] + sum((F.col(n) for n in sums[1:]), F.col(sums[0])), F.col(at("denom")))
    made = [*(at(n) for n in (*codes, *(f"{n}3" for n in codes), "denom", "curve", "else", "piece")), *squares, *orders, *sums]
    return step.withColumn(out, F.when(active, value).otherwise(F.col(at("else")))).drop(*made)


def fixed_point(whole: Column, fraction: Column, denom: Column) -> Column:
    return shift_left(whole, denom) + big(fraction)


def deadzone_residual(el10: Column, params: Column, channel: int) -> Column:
    """Residual of an enhancement code; 0 where residuals are off or the code equals the offset.

    ``params`` has nlq_offset, slope_int, slope, threshold_int, threshold, max_int, max
    (arrays by channel), denom, el_bits and disabled.
    """

    def p(name: str) -> Column:
        return big(F.get(params[name], channel))

    denom, bits = params["denom"], params["el_bits"]
    slope = fixed_point(p("slope_int"), p("slope"), denom)
    threshold = fixed_point(p("threshold_int"), p("threshold"), denom)
    limit = shift_left(fixed_point(p("max_int"), p("max"), denom), 11 - bits)
    t = big(el10) - p("nlq_offset")
    sign = F.signum(t).cast("bigint")
    value = shift_left(t * 2 - sign, 10 - bits)
    dq = value * slope + shift_left(threshold, 11 - bits) * sign
    clipped = F.greatest(F.least(dq, limit), -limit)
    result = shift_right(clipped, denom - 5 - bits)
    return F.when(params["disabled"] | (t == 0), F.lit(0).cast("bigint")).otherwise(result)


def to_output(value: Column) -> Column:
    """Round a 16-bit container value to 10 bit and put it back into a container."""
    code = clamp(F.shiftright(value + 32, CONTAINER_SHIFT), 0, 1023)
    return F.shiftleft(code.cast("int"), CONTAINER_SHIFT)
