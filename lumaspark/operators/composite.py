"""Combining a base and an enhancement layer, sample by sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.reshape import (
    CONTAINER_SHIFT,
    NEUTRAL_CHROMA_16,
    deadzone_residual,
    fixed_point,
    poly_reshape,
    with_mmr,
    to_output,
)
from .planes import HOLE
from .samples import FRAME

SAMPLE = [*FRAME, "plane", "idx"]
NLQ_FIELDS = {
    "vdr_in_max_int": "max_int",
    "vdr_in_max": "max",
    "linear_deadzone_slope_int": "slope_int",
    "linear_deadzone_slope": "slope",
    "linear_deadzone_threshold_int": "threshold_int",
    "linear_deadzone_threshold": "threshold",
}
# Schema of one exported parameter row.
EXPORTED_PARAMS = (
    "denom INT, el_bits INT, disable_residual BOOLEAN, "
    "nlq STRUCT<nlq_offset: ARRAY<BIGINT>, "
    + ", ".join(f"{f}: ARRAY<BIGINT>" for f in NLQ_FIELDS)
    + ">, curves ARRAY<STRUCT<kind: STRING, pivots: ARRAY<BIGINT>, pieces: ARRAY<STRUCT<"
    "order_minus1: INT, constant_int: BIGINT, constant: BIGINT, "
    "coef_int: ARRAY<ARRAY<BIGINT>>, coef: ARRAY<ARRAY<BIGINT>>>>>>"
)


def colocated_luma(chroma: DataFrame, luma: DataFrame, missing: int | None = None) -> DataFrame:
    """Add ``y16``: luma at flat index min(4 * idx, last index) of the frame.

    The last index is one number per frame, so both sides stay equi joins. Where a frame has no sample at that index, ``missing`` takes its place;
    without it the chroma row goes.
    """
    last = luma.groupBy(*FRAME).agg(F.max("idx").alias("_last"))
    placed = chroma.join(last, FRAME).withColumn("_at", F.least(F.col("idx") * 4, F.col("_last")))
    source = luma.select(*FRAME, F.col("idx").alias("_at"), F.col("bl16").alias("y16"))
    if missing is None:
        return placed.join(source, [*FRAME, "_at"]).drop("_at", "_last")
    return placed.join(source, [*FRAME, "_at"], "left").withColumn("y16", F.coalesce("y16", F.lit(missing))).drop("_at", "_last")


def frame_params(frames: DataFrame, params: DataFrame) -> DataFrame:
    """One parameter row per frame; frames past the last row use the last row."""
    last = params.groupBy("clip_id").agg(F.max("frame_idx").alias("_last"))
    asked = frames.select(*FRAME).distinct().join(last, "clip_id").withColumn(
        "_at", F.least(F.col("frame_idx"), F.col("_last"))
    )
    rows = params.withColumnRenamed("frame_idx", "_at")
    return asked.join(rows, ["clip_id", "_at"]).drop("_at", "_last")


def composite(base: DataFrame, enhancement: DataFrame, params: DataFrame) -> DataFrame:
    """Composited samples (clip_id, frame_idx, plane, idx, out16).

    ``base`` has ``bl16`` and ``enhancement`` ``el16`` per (clip, frame, plane, idx); planes
    are 0 = luma, 1 = Cb, 2 = Cr. Chroma rows get their luma and, for Cr, their Cb by
    equi joins on the flat index; the parameters join by frame. A frame known in part has gaps among its indexes: missing luma
    counts as 0, missing Cb as neutral.
    """
    luma = base.where(F.col("plane") == 0).select(*FRAME, "idx", "bl16")
    cb = base.where(F.col("plane") == 1).select(*FRAME, "idx", F.col("bl16").alias("cb_near"))
    chroma = colocated_luma(base.where(F.col("plane") > 0), luma, 0)
    chroma = chroma.join(cb, [*FRAME, "idx"], "left").withColumn(
        "cb_near", F.coalesce("cb_near", F.lit(NEUTRAL_CHROMA_16))
    )
    luma_rows = base.where(F.col("plane") == 0).withColumn("y16", F.col("bl16")).withColumn(
        "cb_near", F.lit(None).cast("int")
    )
    columns = [*SAMPLE, "bl16", "y16", "cb_near"]
    placed = luma_rows.select(columns).unionByName(chroma.select(columns))
    joined = placed.join(enhancement.select(*SAMPLE, "el16"), SAMPLE, "left").join(frame_params(base, params).withColumn("_known", F.lit(True)), FRAME, "left")
    place = F.concat_ws(" ", F.lit(" in clip"), "clip_id", F.lit("frame"), F.col("frame_idx").cast("string"))
    fault = F.when(F.col("_known").isNull(), F.lit("no parameters")).when(F.col("el16").isNull(), F.lit("the enhancement layer ends early"))
    value = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, place)).cast("int")).otherwise(F.col("_value"))
    return with_composite_value(joined, "_value").select(*SAMPLE, value.alias("out16"))


def with_composite_value(joined: DataFrame, out: str) -> DataFrame:
    """Adds the composited value of each sample; the curve is that of the sample's plane."""
    bl, denom, plane = F.col("bl16"), F.col("denom"), F.col("plane")
    cb_in = F.when(plane == 1, bl).otherwise(F.col("cb_near"))
    cr_in = F.when(plane == 1, F.lit(NEUTRAL_CHROMA_16)).otherwise(bl)
    curved = joined.withColumn("_curve", F.get("curves", plane))
    curved = with_mmr(curved, F.col("y16"), cb_in, cr_in, F.col("_curve"), denom, "_mmr")
    shaped = F.when(plane == 0, poly_reshape(bl, F.col("_curve"), denom)).when(F.col("_curve")["kind"] == "mmr", F.col("_mmr")).otherwise(bl.cast("bigint"))
    el10 = F.shiftright(F.col("el16"), CONTAINER_SHIFT)
    params = F.struct(
        *[F.col(c) for c in ("nlq_offset", *NLQ_FIELDS.values(), "denom", "el_bits", "disabled")]
    )
    residual = (
        F.when(plane == 0, deadzone_residual(el10, params, 0))
        .when(plane == 1, deadzone_residual(el10, params, 1))
        .otherwise(deadzone_residual(el10, params, 2))
    )
    return curved.withColumn(out, to_output(shaped + residual)).drop("_curve", "_mmr")


def composite_params(exported: DataFrame) -> DataFrame:
    """Parameter rows (clip_id, frame_idx, nlq arrays, denom, el_bits, disabled, curves).

    A coefficient is its whole part times 2^denom plus its fraction. Without residual
    data the arrays are zero and ``disabled`` is set. ``active`` tells whether any curve
    does more than pass its input through.
    """
    denom = F.col("denom")
    disabled = F.coalesce(F.col("disable_residual"), F.lit(False)) | F.col("nlq").isNull()
    zeros = F.array(*[F.lit(0).cast("bigint")] * 3)

    def nlq(name: str, alias: str) -> Column:
        return F.when(disabled, zeros).otherwise(F.col(f"nlq.{name}")).alias(alias)

    def joined(whole: Column, fraction: Column) -> Column:
        return F.zip_with(whole, fraction, lambda w, f: fixed_point(w, f, denom))

    def piece(p: Column, kind: Column) -> Column:
        coefs = F.zip_with(p["coef_int"], p["coef"], joined)
        is_mmr = kind == "mmr"
        return F.struct(
            F.when(is_mmr, p["order_minus1"] + 1).otherwise(p["order_minus1"]).cast("int").alias("ord"),
            F.when(is_mmr, fixed_point(p["constant_int"], p["constant"], denom)).alias("constant"),
            F.when(is_mmr, coefs)
            .otherwise(F.transform(coefs, lambda c: F.slice(c, F.lit(1), p["order_minus1"] + 2)))
            .alias("coefs"),
        )

    def curve(c: Column) -> Column:
        return F.struct(
            c["kind"].alias("kind"),
            c["pivots"].alias("pivots"),
            F.transform(c["pieces"], lambda p: piece(p, c["kind"])).alias("pieces"),
        )

    def passes_through(p: Column) -> Column:
        line = F.get(p["coefs"], 0)
        return (
            (p["ord"] == 0) & (F.get(line, 0) == 0)
            & (F.get(line, 1) == fixed_point(F.lit(1), F.lit(0), denom))
        )

    rows = exported.select(
        *FRAME,
        nlq("nlq_offset", "nlq_offset"),
        *[nlq(source, alias) for source, alias in NLQ_FIELDS.items()],
        denom,
        "el_bits",
        disabled.alias("disabled"),
        F.transform("curves", curve).alias("curves"),
    )
    acts = F.exists(
        "curves",
        lambda c: (c["kind"] == "mmr")
        | ((c["kind"] == "polynomial") & F.exists(c["pieces"], lambda p: ~passes_through(p))),
    )
    return rows.withColumn("active", acts)


# The same on packed planes: one row per frame, no sample is shuffled ----------------------
PLANES = ("luma", "cb", "cr")
PACKED = "clip_id STRING, frame_idx INT, luma BINARY, cb BINARY, cr BINARY"


def _piece_of(x: np.ndarray, curve: dict) -> np.ndarray:
    """Index of the first piece whose upper pivot lies above each code, else of the last piece."""
    n = len(curve["pieces"])
    return np.minimum(np.searchsorted(np.asarray(curve["pivots"][1:n + 1]), x, side="right"), n - 1)


def _container(fixed: np.ndarray, denom: int) -> np.ndarray:
    return np.clip((fixed >> denom) << CONTAINER_SHIFT, 0, 65535)


def _coefficient(line, i: int) -> int:
    return 0 if line is None or len(line) <= i or line[i] is None else int(line[i])


def _shape_luma(bl: np.ndarray, curve: dict, denom: int) -> np.ndarray:
    if curve["kind"] != "polynomial" or not len(curve["pieces"]):
        return bl
    x = bl >> CONTAINER_SHIFT
    lines = [p["coefs"][0] if len(p["coefs"]) else None for p in curve["pieces"]]
    c = np.array([[_coefficient(line, i) if i < 2 or p["ord"] >= 1 else 0 for i in range(3)] for line, p in zip(lines, curve["pieces"])], np.int64)
    at = _piece_of(x, curve)
    return _container(c[at, 0] + (c[at, 1] + c[at, 2] * x) * x, denom)


def _shape_chroma(bl: np.ndarray, y16: np.ndarray, cb16: np.ndarray, cr16: np.ndarray, curve: dict, denom: int) -> np.ndarray:
    if curve["kind"] != "mmr":
        return bl
    if not len(curve["pieces"]):
        return cb16
    y, cb, cr = (v >> CONTAINER_SHIFT for v in (y16, cb16, cr16))
    at = _piece_of(y, curve)
    out = np.empty_like(bl)
    for number, piece in enumerate(curve["pieces"]):
        here = at == number
        luma, first, second = y[here], cb[here], cr[here]
        total = np.full(len(luma), int(piece["constant"]), np.int64)
        for order in range(1, min(max(int(piece["ord"]), 1), 3) + 1):
            line = piece["coefs"][order - 1] if len(piece["coefs"]) >= order else None
            if line is None or not len(line):
                continue
            k = [_coefficient(line, i) for i in range(7)]
            # Powers of luma and both chroma codes, scaled back after each product.
            a, b, c = luma, first, second
            for _ in range(order - 1):
                a, b, c = ((p * v) >> denom for p, v in ((a, luma), (b, first), (c, second)))
            cross = (((k[3] * a) >> denom) * first) + (((k[4] * a) >> denom) * second) + (((k[5] * b) >> denom) * second)
            lead = (k[6] * a) >> denom
            total += k[0] * a + k[1] * b + k[2] * c + cross + ((lead * first * second if order == 1 else lead * b) >> denom)
        out[here] = _container(total, denom)
    return out


def _residual(el16: np.ndarray, row, channel: int) -> np.ndarray:
    t = (el16 >> CONTAINER_SHIFT) - int(row.nlq_offset[channel])
    if row.disabled:
        return np.zeros_like(t)
    denom, bits = int(row.denom), int(row.el_bits)
    slope, threshold, limit = (
        (int(getattr(row, f"{n}_int")[channel]) << denom) + int(getattr(row, n)[channel]) for n in ("slope", "threshold", "max")
    )
    limit <<= 11 - bits
    sign = np.sign(t)
    dq = ((t * 2 - sign) << (10 - bits)) * slope + (threshold << (11 - bits)) * sign
    return np.where(t == 0, 0, np.clip(dq, -limit, limit) >> (denom - 5 - bits))


def composite_frame(base: list[np.ndarray], enhancement: list[np.ndarray], row) -> list[np.ndarray]:
    """The three composited planes of a frame, as 16-bit words; ``row`` has the frame's parameters. Holes stay holes; for others
    missing luma counts as 0, missing Cb as neutral."""
    luma, denom = base[0], int(row.denom)
    # A chroma sample's luma stands at flat index min(4 * idx, last).
    near = luma[np.minimum(np.arange(len(base[1])) * 4, len(luma) - 1)]
    near, first = np.where(near == HOLE, 0, near), np.where(base[1] == HOLE, NEUTRAL_CHROMA_16, base[1])
    neutral = np.full(len(base[2]), NEUTRAL_CHROMA_16, np.int64)
    shaped = [
        _shape_luma(luma, row.curves[0], denom),
        _shape_chroma(base[1], near, base[1], neutral, row.curves[1], denom),
        _shape_chroma(base[2], near, first, base[2], row.curves[2], denom),
    ]
    sums = [s + _residual(el, row, c) for c, (s, el) in enumerate(zip(shaped, enhancement))]
    words = [np.clip((v + 32) >> CONTAINER_SHIFT, 0, 1023) << CONTAINER_SHIFT for v in sums]
    return [np.where(b == HOLE, HOLE, w) for b, w in zip(base, words)]


def composite_planes(base: DataFrame, enhancement: DataFrame, params: DataFrame) -> DataFrame:
    """``composite`` for frames stored as packed little-endian words (clip_id, frame_idx, luma, cb, cr).

    The join is by frame, so a frame's planes move at most once. A frame without an enhancement row or
    parameters, and a layer of another size or with a hole where the base has a sample, fail the job.
    """
    upper = enhancement.select(*FRAME, *[F.col(p).alias(f"el_{p}") for p in PLANES])
    known = frame_params(base, params)
    rows = base.select(*FRAME, *PLANES).join(upper, FRAME, "left").join(known.withColumn("_known", F.lit(True)), FRAME, "left")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.rename(columns={"_known": "known"}).itertuples(index=False):
                place = f"clip {row.clip_id} frame {row.frame_idx}"
                if row.known is not True and row.known != True:  # noqa: E712  null after the outer join
                    raise ValueError(f"no parameters in {place}")
                below = [np.frombuffer(getattr(row, p), "<u2").astype(np.int64) for p in PLANES]
                above = [np.frombuffer(getattr(row, f"el_{p}") or b"", "<u2").astype(np.int64) for p in PLANES]
                if [len(p) for p in below] != [len(p) for p in above] or any(((b != HOLE) & (a == HOLE)).any() for b, a in zip(below, above)):
                    raise ValueError(f"the enhancement layer ends early or has another size in {place}")
                out.append((row.clip_id, row.frame_idx, *[p.astype("<u2").tobytes() for p in composite_frame(below, above, row)]))
            yield pd.DataFrame(out, columns=["clip_id", "frame_idx", *PLANES])

    return rows.mapInPandas(task, PACKED)
