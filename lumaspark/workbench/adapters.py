"""The driver's tables in the shape of the library's tables.

Every adapter is a projection (no window, no cap), written once for Spark and once as
SQL, with integer or exact double formulas so that both sides agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import transfer as T

CLIPS = 8
MOSAIC_CLIPS = 4
TILE = 8
SIDE = 40
SCENE_FRAMES = 700


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- samples without coordinates, from lineitem -------------------------------------------

SAMPLES_SQL = """
    SELECT clip_id, frame_idx, cb_code, cr_code,
           (64 + (cents * (300 + 30 * no)) // 10500000 + ((frame_idx // 30) * 3 % 5) * 60)::INT AS y_code
    FROM (SELECT l_suppkey % 8 AS no, 'c' || (l_suppkey % 8) AS clip_id,
                 (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 28)::INT AS frame_idx,
                 round(l_extendedprice * 100)::BIGINT AS cents,
                 (288 + l_partkey % 449)::INT AS cb_code, (288 + (l_orderkey * 7) % 449)::INT AS cr_code
          FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % CLIPS).alias("no"),
        F.expr("datediff(to_date(l_shipdate), date'1995-01-01') div 28").cast("int").alias("frame_idx"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        (F.lit(288) + F.col("l_partkey") % 449).cast("int").alias("cb_code"),
        (F.lit(288) + (F.col("l_orderkey") * 7) % 449).cast("int").alias("cr_code"),
    )
    level = F.expr("64 + (cents * (300 + 30 * no)) div 10500000 + ((frame_idx div 30) * 3 % 5) * 60")
    return base.select(
        F.concat(F.lit("c"), F.col("no")).alias("clip_id"), "frame_idx", "cb_code", "cr_code", level.cast("int").alias("y_code")
    )


# --- samples with coordinates, from embeddings ---------------------------------------------
# A frame is a mosaic of 5 x 5 tiles of 8 x 8 samples. Bars of 3 rows per clip number darken its top
# and bottom, and one frame in five of a clip is nearly black.

MOSAIC_PIXELS_SQL = """
    SELECT no, 'm' || no AS clip_id, frame_idx,
           ((tile % 5) * 8 + i % 8)::INT AS x, ((tile // 5) * 8 + i // 8)::INT AS y, e
    FROM (SELECT (vec_id // 25) % 4 AS no, (vec_id // 100)::INT AS frame_idx, vec_id % 25 AS tile,
                 unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings)"""
MOSAIC_LUMA_SQL = f"""
    SELECT clip_id, frame_idx, x, y,
           (CASE WHEN y < 3 * no OR y >= 40 - 3 * no THEN 64
                 WHEN (frame_idx + no) % 5 = 3 THEN 64 + (code - 64) // 200 ELSE code END)::INT AS y_code
    FROM (SELECT *, least(940, greatest(64, floor(502 + 876 * e)))::INT AS code FROM ({MOSAIC_PIXELS_SQL}))"""
MOSAIC_CHROMA_SQL = f"""
    SELECT clip_id, frame_idx, (x // 2)::INT AS cx, (y // 2)::INT AS cy,
           max(CASE WHEN x % 2 = 0 THEN code END)::INT AS cb_code, max(CASE WHEN x % 2 = 1 THEN code END)::INT AS cr_code
    FROM (SELECT *, least(960, greatest(64, floor(512 + 400 * e)))::INT AS code FROM ({MOSAIC_PIXELS_SQL}))
    WHERE y % 2 = 0 GROUP BY ALL"""
MOSAIC_SQL = f"""
    SELECT l.*, c.cb_code, c.cr_code FROM ({MOSAIC_LUMA_SQL}) l
    JOIN ({MOSAIC_CHROMA_SQL}) c ON l.clip_id = c.clip_id AND l.frame_idx = c.frame_idx AND l.x // 2 = c.cx AND l.y // 2 = c.cy"""


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings").select(
        F.expr("(vec_id div 25) % 4").alias("no"),
        F.expr("vec_id div 100").cast("int").alias("frame_idx"),
        (F.col("vec_id") % 25).cast("int").alias("tile"),
        F.posexplode("embedding").alias("i", "e"),
    )
    return base.select(
        "no",
        F.concat(F.lit("m"), F.col("no")).alias("clip_id"),
        "frame_idx",
        F.expr("(tile % 5) * 8 + i % 8").cast("int").alias("x"),
        F.expr("(tile div 5) * 8 + i div 8").cast("int").alias("y"),
        F.col("e").cast("double").alias("e"),
    )


def mosaic_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = T.clamp(F.floor(F.lit(502) + F.lit(876) * F.col("e")), 64, 940).cast("int")
    in_bar = (F.col("y") < 3 * F.col("no")) | (F.col("y") >= 40 - 3 * F.col("no"))
    dark = (F.col("frame_idx") + F.col("no")) % 5 == 3
    level = F.when(in_bar, 64).when(dark, F.expr("64 + (code - 64) div 200")).otherwise(F.col("code"))
    return mosaic_pixels(spark, sf_dir).withColumn("code", code).select(
        "clip_id", "frame_idx", "x", "y", level.cast("int").alias("y_code")
    )


def mosaic_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = T.clamp(F.floor(F.lit(512) + F.lit(400) * F.col("e")), 64, 960).cast("int")
    return (
        mosaic_pixels(spark, sf_dir)
        .where(F.col("y") % 2 == 0)
        .withColumn("code", code)
        .groupBy("clip_id", "frame_idx", F.expr("x div 2").cast("int").alias("cx"), F.expr("y div 2").cast("int").alias("cy"))
        .agg(
            F.max(F.when(F.col("x") % 2 == 0, F.col("code"))).alias("cb_code"),
            F.max(F.when(F.col("x") % 2 == 1, F.col("code"))).alias("cr_code"),
        )
    )


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma and chroma of the mosaic. A sample's chroma site lies in its own tile, so both come
    from the same array and no join is needed."""
    code = lambda at, low, high, mid, gain: T.clamp(
        F.floor(F.lit(mid) + F.lit(gain) * F.get("embedding", at).cast("double")), low, high
    ).cast("int")
    site = F.expr("(i div 16) * 16 + (i % 8) div 2 * 2").cast("int")
    base = table(spark, sf_dir, "embeddings").select(
        F.expr("(vec_id div 25) % 4").alias("no"),
        F.expr("vec_id div 100").cast("int").alias("frame_idx"),
        (F.col("vec_id") % 25).cast("int").alias("tile"),
        "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"),
    )
    placed = base.select(
        "no",
        F.concat(F.lit("m"), F.col("no")).alias("clip_id"),
        "frame_idx",
        F.expr("(tile % 5) * 8 + i % 8").cast("int").alias("x"),
        F.expr("(tile div 5) * 8 + i div 8").cast("int").alias("y"),
        code(F.col("i"), 64, 940, 502, 876).alias("code"),
        code(site, 64, 960, 512, 400).alias("cb_code"),
        code(site + 1, 64, 960, 512, 400).alias("cr_code"),
    )
    in_bar = (F.col("y") < 3 * F.col("no")) | (F.col("y") >= 40 - 3 * F.col("no"))
    dark = (F.col("frame_idx") + F.col("no")) % 5 == 3
    level = F.when(in_bar, 64).when(dark, F.expr("64 + (code - 64) div 200")).otherwise(F.col("code"))
    return placed.select("clip_id", "frame_idx", "x", "y", level.cast("int").alias("y_code"), "cb_code", "cr_code")


MOSAIC_CLIPS_SQL = """
    SELECT clip_id, 40 AS width, 40 AS height, 0::BIGINT AS start_tick, (count(DISTINCT frame_idx) * 1000)::BIGINT AS duration,
           count(DISTINCT frame_idx)::INT AS frame_count
    FROM (SELECT 'm' || ((vec_id // 25) % 4) AS clip_id, vec_id // 100 AS frame_idx FROM embeddings) GROUP BY clip_id"""
MOSAIC_CROPS_SQL = """
    SELECT DISTINCT 'm' || no AS clip_id, (no * 3)::INT AS rx, (no * 2)::INT AS ry, (39 - no * 4)::INT AS rw, (40 - no * 5)::INT AS rh
    FROM (SELECT (vec_id // 25) % 4 AS no FROM embeddings)"""


def mosaic_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("m"), F.expr("(vec_id div 25) % 4")).alias("clip_id"), F.expr("vec_id div 100").alias("f")
    )
    return vectors.groupBy("clip_id").agg(F.countDistinct("f").cast("int").alias("frame_count")).select(
        "clip_id", F.lit(40).alias("width"), F.lit(40).alias("height"), F.lit(0).cast("bigint").alias("start_tick"),
        (F.col("frame_count") * 1000).cast("bigint").alias("duration"), "frame_count",
    )


def mosaic_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given rectangles with odd corners, to exercise the bounds."""
    no = table(spark, sf_dir, "embeddings").select(F.expr("(vec_id div 25) % 4").alias("no")).distinct()
    rect = F.struct(
        (F.col("no") * 3).cast("int").alias("x"), (F.col("no") * 2).cast("int").alias("y"),
        (F.lit(39) - F.col("no") * 4).cast("int").alias("width"), (F.lit(40) - F.col("no") * 5).cast("int").alias("height"),
    )
    return no.select(F.concat(F.lit("m"), F.col("no")).alias("clip_id"), rect.alias("rect"))


# --- frame series, from events -------------------------------------------------------------

SERIES_SQL = """
    SELECT 'u' || (event_id % 8) AS clip_id, (event_id // 8)::INT AS frame_idx, (event_id // 5600)::INT AS scene_id,
           ((event_id // 8) % 700)::INT AS scene_pos, value AS avg_nits, value * (1 + k / 10.0::DOUBLE) AS peak_nits, k, event_id, event_type, ts
    FROM (SELECT *, (props->>'k')::INT AS k FROM events)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("event_id") % CLIPS).alias("clip_id"),
        F.expr("event_id div 8").cast("int").alias("frame_idx"),
        F.expr("event_id div 5600").cast("int").alias("scene_id"),
        F.expr("(event_id div 8) % 700").cast("int").alias("scene_pos"),
        F.col("value").alias("avg_nits"),
        (F.col("value") * (F.lit(1) + k / F.lit(10.0))).alias("peak_nits"),
        k.alias("k"),
        "event_id",
        "event_type",
        "ts",
    )


# --- SQL spelling of the scalar functions ----------------------------------------------------


def sql_nits_to_pq(n: str) -> str:
    y = f"pow(greatest(({n}) / 10000.0::DOUBLE, 0), {T.M1!r}::DOUBLE)"
    return f"pow(({T.C1!r}::DOUBLE + {T.C2!r}::DOUBLE * {y}) / (1 + {T.C3!r}::DOUBLE * {y}), {T.M2!r}::DOUBLE)"


def sql_pq_to_nits(p: str) -> str:
    e = f"pow({p}, {1.0 / T.M2!r}::DOUBLE)"
    return (
        f"(CASE WHEN {p} <= 0 THEN 0.0::DOUBLE ELSE pow(greatest({e} - {T.C1!r}::DOUBLE, 0) / "
        f"({T.C2!r}::DOUBLE - {T.C3!r}::DOUBLE * {e}), {1.0 / T.M1!r}::DOUBLE) * 10000.0::DOUBLE END)"
    )


def sql_pq12(p: str) -> str:
    return f"round(least(greatest({p}, 0), 1) * 4095)::INT"


def sql_luma(y: str = "y_code") -> str:
    return f"least(greatest(({y} - 64) / 876.0::DOUBLE, 0), 1)"


def sql_max_rgb() -> str:
    luma, cb, cr = "((y_code - 64) / 876.0::DOUBLE)", "((cb_code - 512) / 896.0::DOUBLE)", "((cr_code - 512) / 896.0::DOUBLE)"
    red, blue = f"({luma} + 1.4746::DOUBLE * {cr})", f"({luma} + 1.8814::DOUBLE * {cb})"
    green = f"(({luma} - 0.2627::DOUBLE * {red} - 0.0593::DOUBLE * {blue}) / 0.678::DOUBLE)"
    return f"least(greatest({red}, {green}, {blue}, 0), 1)"


def sql_lum_bin(p: str) -> str:
    low, high = T.SDR_PEAK_PQ / 64, (1.0 - T.SDR_PEAK_PQ) / 192
    return (
        f"least(CASE WHEN {p} < {T.SDR_PEAK_PQ!r}::DOUBLE THEN floor({p} / {low!r}::DOUBLE) "
        f"ELSE 64 + floor(({p} - {T.SDR_PEAK_PQ!r}::DOUBLE) / {high!r}::DOUBLE) END, 255)::INT"
    )


def sql_hlg_relative(s: str) -> str:
    c = f"least(greatest({s}, 0), 1)"
    return (
        f"(CASE WHEN {c} <= 0.5 THEN {c} * {c} / 3.0::DOUBLE ELSE "
        f"(exp(({c} - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12.0::DOUBLE END)"
    )


def sql_hue_bin() -> str:
    angle = "(degrees(atan2((cr_code - 512)::DOUBLE, (cb_code - 512)::DOUBLE)) + 360.0::DOUBLE)"
    turned = f"(CASE WHEN {angle} >= 360 THEN {angle} - 360 ELSE {angle} END)"
    return (
        f"(CASE WHEN sqrt((cb_code - 512) * (cb_code - 512) + (cr_code - 512) * (cr_code - 512)) >= 10 "
        f"THEN least(floor({turned} * 31 / 360.0::DOUBLE), 30)::INT END)"
    )
