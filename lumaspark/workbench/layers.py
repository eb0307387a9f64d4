"""Base and enhancement layers: fixed-point reshaping, residuals and the composite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reshape as R
from ..operators import composite as C
from ..operators.planes import HOLE
from . import adapters as A
from . import packing
from .registry import query

FRAME = ["clip_id", "frame_idx"]
SAMPLE = ["clip_id", "frame_idx", "y_code", "cb_code", "cr_code"]
KEY = "clip_id, frame_idx"
NO = "substr(clip_id, 2, 1)::BIGINT"
BIG = "array<bigint>"


def no():
    return F.substring("clip_id", 2, 1).cast("bigint")


def bigs(*values):
    return F.array(*[v.cast("bigint") if not isinstance(v, int) else F.lit(v).cast("bigint") for v in values])


def piece(order, constant, *rows):
    return F.struct(F.lit(order).alias("ord"), (constant if not isinstance(constant, int) else F.lit(constant)).cast("bigint").alias("constant"), F.array(*rows).alias("coefs"))


def poly_curve(number):
    pieces = F.array(
        piece(0, 0, bigs(number * 8388608, 1 << 23)),
        piece(0, 0, bigs(-5 * 8388608, (1 << 23) + 12345)),
        piece(1, 0, bigs(0, 1 << 22, 4097)),
    )
    return F.struct(F.lit("polynomial").alias("kind"), bigs(0, 300, 600, 1023).alias("pivots"), pieces.alias("pieces"))


def poly_sql(x: str, number: str = NO) -> str:
    r = f"(CASE WHEN {x} < 300 THEN {number} * 8388608 + 8388608 * {x} WHEN {x} < 600 THEN -41943040 + 8400953 * {x} ELSE 4194304 * {x} + 4097 * {x} * {x} END)"
    return f"least(greatest(({r} >> 23) * 64, 0), 65535)::BIGINT"


MMR_ROWS = (
    ((700, -200, 150, 3, -2, 5, 1), (40, 30, -20, 2, 1, -3, 2), (5, -4, 3, 1, -1, 2, 1)),
    ((900, 100, -50, -1, 4, 2, -3), (-10, 20, 30, -2, 3, 1, 1), (2, 6, -5, 1, 1, -1, 2)),
)


def mmr_curve(number):
    pieces = F.array(
        piece(1, number * 1024, bigs(*MMR_ROWS[0][0])),
        piece(3, number * 2048 - 7777, *[bigs(*row) for row in MMR_ROWS[1]]),
    )
    return F.struct(F.lit("mmr").alias("kind"), bigs(0, 400, 1023).alias("pivots"), pieces.alias("pieces"))


def mmr_sql(y: str, cb: str, cr: str, number: str = NO, d: int = 10) -> str:
    """Order 1 below luma 400, order 3 above; ``d`` is the shift."""

    def first(k):
        return (
            f"{k[0]} * {y} + {k[1]} * {cb} + {k[2]} * {cr} + (({k[3]} * {y}) >> {d}) * {cb} + (({k[4]} * {y}) >> {d}) * {cr} + (({k[5]} * {cb}) >> {d}) * {cr}"
            f" + (((({k[6]} * {y}) >> {d}) * {cb} * {cr}) >> {d})"
        )

    def higher(k, p):
        a, b, c = (p(v) for v in (y, cb, cr))
        return (
            f"{k[0]} * {a} + {k[1]} * {b} + {k[2]} * {c} + (({k[3]} * {a}) >> {d}) * {cb} + (({k[4]} * {a}) >> {d}) * {cr} + (({k[5]} * {b}) >> {d}) * {cr}"
            f" + (((({k[6]} * {a}) >> {d}) * {b}) >> {d})"
        )

    square = lambda v: f"(({v} * {v}) >> {d})"
    cube = lambda v: f"(((({v} * {v}) >> {d}) * {v}) >> {d})"
    low = f"{number} * 1024 + {first(MMR_ROWS[0][0])}"
    high = f"{number} * 2048 - 7777 + {first(MMR_ROWS[1][0])} + {higher(MMR_ROWS[1][1], square)} + {higher(MMR_ROWS[1][2], cube)}"
    return f"least(greatest(((CASE WHEN {y} < 400 THEN {low} ELSE {high} END) >> {d}) * 64, 0), 65535)::BIGINT"


_WIDE = f"SELECT clip_id, frame_idx, y_code, cb_code, cr_code, y_code::BIGINT AS y, cb_code::BIGINT AS cb, cr_code::BIGINT AS cr FROM ({A.SAMPLES_SQL})"


def words(column):
    return F.shiftleft(F.col(column), 6)


def with_curve(samples, build):
    """Curves are facts of a clip (or frame), so they come by a join and not per sample."""
    clips = samples.select("clip_id").distinct().select("clip_id", build(no()).alias("curve"))
    return samples.join(clips, "clip_id")


@query("f19_poly_reshape", f"SELECT {', '.join(SAMPLE)}, {poly_sql('y')} AS v FROM ({_WIDE})")
def f19(spark, sf_dir):
    shaped = R.poly_reshape(words("y_code"), F.col("curve"), F.lit(23))
    return with_curve(A.samples(spark, sf_dir), poly_curve).select(*SAMPLE, shaped.alias("v"))


@query("f20_mmr_reshape", f"SELECT {', '.join(SAMPLE)}, {mmr_sql('y', 'cb', 'cr')} AS v FROM ({_WIDE})")
def f20(spark, sf_dir):
    samples = with_curve(A.samples(spark, sf_dir), mmr_curve)
    return R.with_mmr(samples, words("y_code"), words("cb_code"), words("cr_code"), F.col("curve"), F.lit(10), "v").select(*SAMPLE, "v")


@query("j11_piece_lookup", f"SELECT {', '.join(SAMPLE)}, CASE WHEN y < 600 THEN 0 ELSE 1 END AS ord, CASE WHEN y < 300 THEN 8388608 WHEN y < 600 THEN 8400953 ELSE 4194304 END::BIGINT AS slope FROM ({_WIDE})")
def j11(spark, sf_dir):
    found = R.piece_for(F.col("y_code"), F.col("curve"))
    return with_curve(A.samples(spark, sf_dir), poly_curve).select(*SAMPLE, found["ord"].alias("ord"), F.get(F.get(found["coefs"], 0), 1).alias("slope"))


# The residual: offset 512, ten bits, slope and threshold grow with the clip number.
def deadzone_sql(el: str, number: str = NO) -> str:
    t = f"({el} - 512)"
    s = f"sign({t})::BIGINT"
    limit = "((0::BIGINT * 8388608 + 1048576) * 2)"
    dq = f"((({t} * 2 - {s}) * (1000 * ({number} + 1)) + (500 * ({number} + 1)) * 2 * {s}))"
    return f"(CASE WHEN {t} = 0 THEN 0 ELSE (least(greatest({dq}, -{limit}), {limit}) >> 8) END)::BIGINT"


def nlq_params(number, disabled=False):
    return F.struct(
        bigs(512, 512, 512).alias("nlq_offset"), bigs(0, 0, 0).alias("max_int"), bigs(1048576, 1048576, 1048576).alias("max"),
        bigs(0, 0, 0).alias("slope_int"), bigs(*[(number + 1) * 1000] * 3).alias("slope"), bigs(0, 0, 0).alias("threshold_int"),
        bigs(*[(number + 1) * 500] * 3).alias("threshold"), F.lit(23).alias("denom"), F.lit(10).alias("el_bits"), F.lit(disabled).alias("disabled"),
    )


@query("f21_deadzone_residual", f"SELECT {', '.join(SAMPLE)}, {deadzone_sql('cb')} AS residual FROM ({_WIDE})")
def f21(spark, sf_dir):
    return A.samples(spark, sf_dir).select(*SAMPLE, R.deadzone_residual(F.col("cb_code"), nlq_params(no()), 1).alias("residual"))


# Layers of the mosaic ---------------------------------------------------------------------
BASE_SQL = f"""
    SELECT {KEY}, 0 AS plane, (y * 40 + x)::INT AS idx, y_code::BIGINT AS code FROM ({A.MOSAIC_LUMA_SQL})
    UNION ALL SELECT {KEY}, 1, (cy * 20 + cx)::INT, cb_code::BIGINT FROM ({A.MOSAIC_CHROMA_SQL}) UNION ALL SELECT {KEY}, 2, (cy * 20 + cx)::INT, cr_code::BIGINT FROM ({A.MOSAIC_CHROMA_SQL})"""


def base(spark, sf_dir):
    luma = A.mosaic_luma(spark, sf_dir).select(*FRAME, F.lit(0).alias("plane"), (F.col("y") * 40 + F.col("x")).alias("idx"), F.col("y_code").alias("code"))
    sites = A.mosaic_chroma(spark, sf_dir).withColumn("idx", F.col("cy") * 20 + F.col("cx"))
    chroma = sites.select(*FRAME, F.posexplode(F.array("cb_code", "cr_code")).alias("p", "code"), "idx").select(*FRAME, (F.col("p") + 1).alias("plane"), "idx", "code")
    return luma.unionByName(chroma)


@query("j9_colocated_luma", f"""
    SELECT c.clip_id, c.frame_idx, c.plane, c.idx, l.code * 64 AS y16 FROM ({BASE_SQL}) c JOIN (SELECT {KEY}, max(idx) AS last FROM ({BASE_SQL}) WHERE plane = 0 GROUP BY ALL) m USING (clip_id, frame_idx)
    JOIN ({BASE_SQL}) l ON l.plane = 0 AND l.clip_id = c.clip_id AND l.frame_idx = c.frame_idx AND l.idx = least(c.idx * 4, last) WHERE c.plane > 0""")
def j9(spark, sf_dir):
    layer = base(spark, sf_dir).withColumn("bl16", F.shiftleft("code", 6).cast("bigint")).drop("code")
    luma = layer.where(F.col("plane") == 0).select(*FRAME, "idx", "bl16")
    return C.colocated_luma(layer.where(F.col("plane") > 0), luma).select(*FRAME, "plane", "idx", "y16")


# Exported parameters: clip 0 polynomial luma, clip 1 regression chroma, clip 2 both, clip 3 nothing.
# Frames from the third on have no parameter row and use the last one.
EXPORTED_SQL = "SELECT DISTINCT 'm' || ((vec_id // 25) % 4) AS clip_id, (vec_id // 100)::INT AS frame_idx, (vec_id // 25) % 4 AS no FROM embeddings"


def exported(spark, sf_dir):
    frames = A.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("m"), F.expr("(vec_id div 25) % 4")).alias("clip_id"), F.expr("vec_id div 100").cast("int").alias("frame_idx"), F.expr("(vec_id div 25) % 4").alias("no")
    ).distinct()
    n = F.col("no")
    split = lambda order, const, *rows: F.struct(
        F.lit(order).alias("order_minus1"), F.lit(0).cast("bigint").alias("constant_int"), const.cast("bigint").alias("constant"),
        F.array(*[bigs(*[v[0] for v in row]) for row in rows]).alias("coef_int"), F.array(*[bigs(*[v[1] for v in row]) for row in rows]).alias("coef"),
    )
    zero = F.lit(0)
    poly = F.array(
        split(0, zero, ((n, 0), (1, 0))), split(0, zero, ((-5, 0), (1, 12345))), split(1, zero, ((0, 0), (0, 1 << 22), (0, 4097))),
    )
    mmr = F.array(
        split(0, n * 1024, *[tuple((0, v) for v in MMR_ROWS[0][0])]),
        split(2, n * 2048 - 7777, *[tuple((0, v) for v in row) for row in MMR_ROWS[1]]),
    )
    curve = lambda kind, pivots, pieces: F.struct(F.lit(kind).alias("kind"), bigs(*pivots).alias("pivots"), pieces.alias("pieces"))
    none = F.struct(F.lit("identity").alias("kind"), bigs(0, 1023).alias("pivots"), F.slice(poly, 1, 0).alias("pieces"))
    luma = F.when(n % 2 == 0, curve("polynomial", (0, 300, 600, 1023), poly)).otherwise(none)
    chroma = F.when((n == 1) | (n == 2), curve("mmr", (0, 400, 1023), mmr)).otherwise(none)
    nlq = F.struct(
        bigs(512, 512, 512).alias("nlq_offset"), bigs(0, 0, 0).alias("vdr_in_max_int"), bigs(*[1048576] * 3).alias("vdr_in_max"), bigs(0, 0, 0).alias("linear_deadzone_slope_int"),
        bigs(*[(n + 1) * 1000] * 3).alias("linear_deadzone_slope"), bigs(0, 0, 0).alias("linear_deadzone_threshold_int"), bigs(*[(n + 1) * 500] * 3).alias("linear_deadzone_threshold"),
    )
    return frames.select(
        *FRAME, F.lit(23).alias("denom"), F.lit(10).alias("el_bits"), (n == 3).alias("disable_residual"), F.when(F.col("frame_idx") % 5 != 1, nlq).alias("nlq"),
        F.array(luma, chroma, chroma).alias("curves"),
    )


@query("j12_composite_params", f"""
    SELECT clip_id, frame_idx, no = 3 OR frame_idx % 5 = 1 AS disabled, CASE WHEN no = 3 OR frame_idx % 5 = 1 THEN 0 ELSE (no + 1) * 1000 END::BIGINT AS slope, no != 3 AS active,
           CASE WHEN no % 2 = 0 THEN no * 8388608 + 8388608 - 41943040 + 8400953 + 4194304 + 4097 ELSE 0 END::BIGINT AS luma_total, CASE WHEN no IN (1, 2) THEN no * 3072 - 7777 + {sum(sum(row) for rows in (MMR_ROWS[0][:1], MMR_ROWS[1]) for row in rows)} ELSE 0 END::BIGINT AS chroma_total, CASE WHEN no IN (1, 2) THEN 4 ELSE 0 END AS orders
    FROM ({EXPORTED_SQL})""")
def j12(spark, sf_dir):
    total = lambda c: F.aggregate(F.flatten(F.flatten(F.transform(c["pieces"], lambda p: p["coefs"]))), F.lit(0).cast("bigint"), lambda a, v: a + v)
    constants = lambda c: F.aggregate(c["pieces"], F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p["constant"], F.lit(0)))
    orders = lambda c: F.aggregate(c["pieces"], F.lit(0), lambda a, p: a + p["ord"])
    luma, chroma = F.get("curves", 0), F.get("curves", 1)
    return C.composite_params(exported(spark, sf_dir)).select(
        *FRAME, "disabled", F.get("slope", 0).alias("slope"), "active", total(luma).alias("luma_total"), (total(chroma) + constants(chroma)).alias("chroma_total"), orders(chroma).alias("orders")
    )


_EL = "((code * 7 + idx) % 1024)"
COMPOSITE_SQL = f"""
    WITH b AS MATERIALIZED ({BASE_SQL}), facts AS (SELECT {KEY}, max(idx) AS last FROM b WHERE plane = 0 GROUP BY ALL),
    placed AS (SELECT b.*, coalesce(l.code, 0) AS y, CASE WHEN b.plane = 1 THEN b.code ELSE c.code END AS cb, CASE WHEN b.plane = 1 THEN 512 ELSE b.code END AS cr, {NO.replace('clip_id', 'b.clip_id')} AS no,
        b.frame_idx AS used, (b.code * 7 + b.idx) % 1024 AS el FROM b JOIN facts USING (clip_id, frame_idx)
      LEFT JOIN b l ON b.plane > 0 AND l.plane = 0 AND l.clip_id = b.clip_id AND l.frame_idx = b.frame_idx AND l.idx = least(b.idx * 4, last)
      LEFT JOIN b c ON b.plane = 2 AND c.plane = 1 AND c.clip_id = b.clip_id AND c.frame_idx = b.frame_idx AND c.idx = b.idx)
    SELECT {KEY}, plane, idx, (least(greatest((CASE WHEN plane = 0 AND no % 2 = 0 THEN {poly_sql('code', 'no')} WHEN plane > 0 AND no IN (1, 2) THEN {mmr_sql('y', 'cb', 'cr', 'no', 23)} ELSE code * 64 END
        + CASE WHEN no = 3 OR used % 5 = 1 THEN 0 ELSE {deadzone_sql('el', 'no')} END + 32) >> 6, 0), 1023) * 64)::INT AS out16 FROM placed"""


def composite_inputs(spark, sf_dir):
    layer = base(spark, sf_dir)
    el = F.shiftleft((F.col("code") * 7 + F.col("idx")) % 1024, 6)
    enhancement = layer.select(*FRAME, "plane", "idx", el.alias("el16"))
    lower = layer.select(*FRAME, "plane", "idx", F.shiftleft("code", 6).alias("bl16"))
    return lower, enhancement, C.composite_params(exported(spark, sf_dir))


@query("j8_composite", COMPOSITE_SQL)
def j8(spark, sf_dir):
    return C.composite(*composite_inputs(spark, sf_dir))


def packed(layer, value: str):
    """Planes of long samples as little-endian words, one row per frame. A plane ends with its last sample; gaps are holes."""
    rows = layer.select(*FRAME, "plane", F.struct(F.col("idx").alias("at"), packing.word(F.col(value)).alias("v")).alias("s"))
    placed = rows.groupBy(*FRAME).agg(*[F.sort_array(F.collect_list(F.when(F.col("plane") == i, F.col("s")))).alias(name) for i, name in enumerate(C.PLANES)])
    size = lambda name: F.coalesce(F.get(name, F.size(name) - 1)["at"] + 1, F.lit(0))
    return placed.select(*FRAME, *[F.unhex(packing.text(F.col(name), size(name))).alias(name) for name in C.PLANES])


def unpacked(planes, value: str):
    """Long samples (plane, idx) of packed words; holes give no row."""
    def words(name: str):
        text = F.hex(name)
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.octet_length(name), 1) - 1), lambda i: F.conv(
            F.concat(F.substring(text, (i * 4 + 3).cast("int"), F.lit(2)), F.substring(text, (i * 4 + 1).cast("int"), F.lit(2))), 16, 10).cast("int"))

    parts = [planes.select(*FRAME, F.lit(i).alias("plane"), F.posexplode(words(name)).alias("idx", value)) for i, name in enumerate(C.PLANES)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col(value) != HOLE)


@query("j8_composite_planes", COMPOSITE_SQL)
def j8_planes(spark, sf_dir):
    """The same samples, composited as packed planes."""
    lower, enhancement, params = composite_inputs(spark, sf_dir)
    return unpacked(C.composite_planes(packed(lower, "bl16"), packed(enhancement, "el16"), params), "out16")
