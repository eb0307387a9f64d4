"""Sample selection and per-frame measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import transfer as T
from ..sources import readers
from ..operators import grain, measure, planes, samples as S
from . import adapters as A
from . import packing
from .registry import query
from .scalars import six

FRAME = ["clip_id", "frame_idx"]
KEY = "clip_id, frame_idx"
LUMA, RGB = A.sql_luma(), A.sql_max_rgb()
RGB_CODE = f"round({RGB} * 4095)::INT"

# Shared SQL fragments ---------------------------------------------------------------------
FINE_SQL = f"SELECT {KEY}, {RGB_CODE} AS bin, count(*) AS n FROM ({A.SAMPLES_SQL}) GROUP BY ALL"
LUM_SQL = f"SELECT {KEY}, {A.sql_lum_bin(LUMA)} AS bin, count(*) AS n FROM ({A.SAMPLES_SQL}) GROUP BY ALL"
LUM_PCT_SQL = f"SELECT {KEY}, bin, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {KEY}) AS pct FROM ({LUM_SQL})"


def low_sql(source: str, p: float, extra: str = "") -> str:
    """Smallest bin with a running count above the ignored share."""
    return f"""
    SELECT {KEY}, min(CASE WHEN cum > floor({p / 100.0!r}::DOUBLE * total) THEN bin END) AS bin, max(bin) AS top FROM (
      SELECT *, sum(n) OVER (PARTITION BY {KEY} ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {KEY}) AS total FROM ({source}))
    GROUP BY {KEY}"""


def high_sql(source: str, p: float) -> str:
    return f"""
    SELECT {KEY}, max(CASE WHEN cum > floor({(100.0 - p) / 100.0!r}::DOUBLE * total) THEN bin END) AS bin, min(bin) AS bottom FROM (
      SELECT *, sum(n) OVER (PARTITION BY {KEY} ORDER BY bin DESC) AS cum, sum(n) OVER (PARTITION BY {KEY}) AS total FROM ({source}))
    GROUP BY {KEY}"""


def top_sql(source: str, target: float) -> str:
    """Highest bin with at least ``target`` percent at or above it (counts compared exactly)."""
    return f"""
    SELECT {KEY}, coalesce(max(CASE WHEN cum * 100.0::DOUBLE >= {target!r}::DOUBLE * total THEN bin END), max(bin)) AS bin FROM (
      SELECT *, sum(n) OVER (PARTITION BY {KEY} ORDER BY bin DESC) AS cum, sum(n) OVER (PARTITION BY {KEY}) AS total FROM ({source}))
    GROUP BY {KEY}"""


# Selection --------------------------------------------------------------------------------
@query("s1_pixel_scan", f"""
    SELECT clip_id, frame_idx, count(*) AS n, sum(y_code)::BIGINT AS codes FROM ({A.MOSAIC_LUMA_SQL})
    WHERE x BETWEEN 2 AND 31 AND y BETWEEN 4 AND 35 GROUP BY ALL""")
def s1(spark, sf_dir):
    lit = A.mosaic_luma(spark, sf_dir).where(F.col("x").between(2, 31) & F.col("y").between(4, 35))
    return lit.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.sum("y_code").alias("codes"))


_WORD = "((l_partkey * 2654435761 + l_orderkey) % 65536)::INT"


@query("s3_p010_unpack", f"""
    SELECT word, (word >> 6) & 1023 AS p010, word & 1023 AS planar, count(*) AS n FROM (SELECT {_WORD} AS word FROM lineitem) GROUP BY ALL""")
def s3(spark, sf_dir):
    word = ((F.col("l_partkey") * 2654435761 + F.col("l_orderkey")) % 65536).cast("int")
    words = A.table(spark, sf_dir, "lineitem").select(word.alias("word"))
    return words.groupBy(
        "word", T.unpack_code("word", "p010").alias("p010"), T.unpack_code("word").alias("planar")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("j1_attach_chroma", f"SELECT clip_id, frame_idx, x, y, y_code, cb_code, cr_code FROM ({A.MOSAIC_SQL})")
def j1(spark, sf_dir):
    return S.attach_chroma(A.mosaic_luma(spark, sf_dir), A.mosaic_chroma(spark, sf_dir))


@query("j2_attach_crop", f"""
    SELECT l.clip_id, frame_idx, count(*) AS n, max(rx) AS x, max(ry) AS y, max(rw) AS w, max(rh) AS h
    FROM ({A.MOSAIC_LUMA_SQL}) l JOIN ({A.MOSAIC_CROPS_SQL}) c ON l.clip_id = c.clip_id GROUP BY ALL""")
def j2(spark, sf_dir):
    joined = S.attach_crop(A.mosaic_luma(spark, sf_dir), A.mosaic_crops(spark, sf_dir))
    return joined.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n"), F.max("rect.x").alias("x"), F.max("rect.y").alias("y"),
        F.max("rect.width").alias("w"), F.max("rect.height").alias("h"),
    )


CROPPED_SQL = f"""
    SELECT l.*, rx, ry, rw, rh FROM ({A.MOSAIC_SQL}) l JOIN ({A.MOSAIC_CROPS_SQL}) c ON l.clip_id = c.clip_id
    WHERE x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh"""


@query("p1_crop_samples", f"SELECT clip_id, frame_idx, x, y, y_code FROM ({CROPPED_SQL})")
def p1(spark, sf_dir):
    return S.crop_samples(A.mosaic_luma(spark, sf_dir), A.mosaic_crops(spark, sf_dir)).select(*FRAME, "x", "y", "y_code")


@query("p1_clip_without_crop", f"""
    SELECT l.clip_id, frame_idx, count(*) AS n, min(x) AS left_x, max(y) AS bottom_y FROM ({A.MOSAIC_SQL}) l
    LEFT JOIN (SELECT * FROM ({A.MOSAIC_CROPS_SQL}) WHERE ascii(right(clip_id, 1)) % 3 != 0) c ON l.clip_id = c.clip_id
    WHERE rx IS NULL OR (x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh) GROUP BY ALL""")
def p1_without(spark, sf_dir):
    """Every third clip has no crop and counts whole."""
    some = A.mosaic_crops(spark, sf_dir).where(F.ascii(F.right("clip_id", F.lit(1))) % 3 != 0)
    return S.crop_samples(A.mosaic_luma(spark, sf_dir), some).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("left_x"), F.max("y").alias("bottom_y"))


@query("p2_frame_sampling", f"SELECT clip_id, frame_idx, count(*) AS n FROM ({A.SAMPLES_SQL}) WHERE frame_idx % 3 = 0 GROUP BY ALL")
def p2(spark, sf_dir):
    return S.every_nth_frame(A.samples(spark, sf_dir), 3).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))


@query("p3_spatial_stride", f"SELECT clip_id, frame_idx, x, y, y_code FROM ({CROPPED_SQL}) WHERE (x - rx) % 2 = 0 AND (y - ry) % 2 = 0")
def p3(spark, sf_dir):
    return S.stride_samples(A.mosaic_luma(spark, sf_dir), A.mosaic_crops(spark, sf_dir), 2).select(*FRAME, "x", "y", "y_code")


# Histograms -------------------------------------------------------------------------------
@query("a1_lum_histogram", f"SELECT {KEY}, bin, n, round(pct, 6) AS pct FROM (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {KEY}) AS pct FROM ({LUM_SQL}))")
def a1(spark, sf_dir):
    hist = measure.percents(measure.lum_histogram(A.samples(spark, sf_dir)))
    return hist.withColumn("pct", F.round("pct", 6))


@query("a2_hue_histogram", f"""
    SELECT {KEY}, bin, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {KEY}), 6) AS pct FROM (
      SELECT l.clip_id, frame_idx, {A.sql_hue_bin()} AS bin, count(*) AS n
      FROM ({A.MOSAIC_SQL}) l JOIN ({A.MOSAIC_CROPS_SQL}) c ON l.clip_id = c.clip_id
      WHERE x % 2 = 0 AND y % 2 = 0 AND x // 2 >= rx // 2 AND x // 2 < rx // 2 + rw // 2 AND y // 2 >= ry // 2 AND y // 2 < ry // 2 + rh // 2
      GROUP BY ALL) WHERE bin IS NOT NULL""")
def a2(spark, sf_dir):
    hist = measure.hue_histogram(A.mosaic(spark, sf_dir), A.mosaic_crops(spark, sf_dir))
    return measure.percents(hist).withColumn("pct", F.round("pct", 6))


@query("a3_fine_histogram", FINE_SQL)
def a3(spark, sf_dir):
    return measure.fine_histogram(A.samples(spark, sf_dir))


@query("a4_frame_levels", f"""
    SELECT {KEY}, round(max({LUMA}), 6) AS max_luma, round(max({RGB}), 6) AS max_rgb, round(least(avg({LUMA}), 1), 6) AS avg_pq,
           round(least(avg({RGB}), 1), 6) AS avg_max_rgb_pq, count(*) AS n FROM ({A.SAMPLES_SQL}) GROUP BY ALL""")
def a4(spark, sf_dir):
    levels = measure.frame_levels(A.samples(spark, sf_dir))
    return levels.select(*FRAME, *[six(F.col(c), c) for c in ("max_luma", "max_rgb", "avg_pq", "avg_max_rgb_pq")], "n")


@query("a5_merge_histograms", f"""
    SELECT clip_id, bin, sum(n)::BIGINT AS n FROM (
      SELECT clip_id, bin, n FROM ({FINE_SQL}) UNION ALL
      SELECT clip_id, round({LUMA} * 4095)::INT, count(*) FROM ({A.SAMPLES_SQL}) GROUP BY ALL) GROUP BY ALL""")
def a5(spark, sf_dir):
    given = A.samples(spark, sf_dir)
    both = [measure.fine_histogram(given, domain).drop("frame_idx") for domain in ("max-rgb", "luma")]
    return measure.merge_histograms(*both)


@query("a4_code_counts", f"SELECT {KEY}, y_code, cb_code, cr_code, count(*) AS n FROM ({A.SAMPLES_SQL}) GROUP BY ALL")
def code_counts(spark, sf_dir):
    return measure.code_counts(A.samples(spark, sf_dir))


@query("a6_low_percentile", f"SELECT {KEY}, round(coalesce(bin, top) / 4095.0::DOUBLE, 6) AS pq FROM ({low_sql(FINE_SQL, 10.0)})")
def a6(spark, sf_dir):
    hist = measure.fine_histogram(A.samples(spark, sf_dir))
    return measure.low_percentile(hist, 10.0).withColumn("pq", F.round("pq", 6))


@query("a7_high_percentile", f"SELECT {KEY}, round(coalesce(bin, bottom) / 4095.0::DOUBLE, 6) AS pq FROM ({high_sql(FINE_SQL, 90.0)})")
def a7(spark, sf_dir):
    hist = measure.fine_histogram(A.samples(spark, sf_dir))
    return measure.high_percentile(hist, 90.0).withColumn("pq", F.round("pq", 6))


@query("a8_min_pq", f"SELECT {KEY}, round(coalesce(bin, top) / 4095.0::DOUBLE, 6) AS min_pq FROM ({low_sql(FINE_SQL, 0.1)})")
def a8(spark, sf_dir):
    return measure.min_pq(measure.fine_histogram(A.samples(spark, sf_dir))).withColumn("min_pq", F.round("min_pq", 6))


def _dense_lum(spark, sf_dir):
    entries = measure.as_entries(measure.lum_histogram(A.samples(spark, sf_dir)))
    total = E.total_count(F.col("entries"))
    return entries.select(*FRAME, E.let(total, lambda n: measure.dense(F.col("entries"), n, T.LUM_BINS)).alias("lum_hist"))


# Percent sums in floating point may land on either side of a round border; targets that
# no count ratio meets exactly keep both sides equal.
@query("a9_lum_percentile", f"SELECT {KEY}, round(bin / 255.0::DOUBLE, 6) AS pq FROM ({top_sql(LUM_SQL, 100.0 - 93.0713)})")
def a9(spark, sf_dir):
    return _dense_lum(spark, sf_dir).select(*FRAME, six(E.lum_percentile_pq(F.col("lum_hist"), 93.0713), "pq"))


@query("a10_highlight_knee", f"SELECT {KEY}, round({A.sql_pq_to_nits('(bin / 255.0::DOUBLE)')}, 4) AS knee_nits FROM ({top_sql(LUM_SQL, 1.0)})")
def a10(spark, sf_dir):
    return _dense_lum(spark, sf_dir).select(*FRAME, F.round(E.highlight_knee_nits(F.col("lum_hist")), 4).alias("knee_nits"))


@query("a11_select_peak", f"""
    SELECT m.clip_id, m.frame_idx, round(direct, 6) AS direct, round(a.bin / 255.0::DOUBLE, 6) AS h99, round(b.bin / 255.0::DOUBLE, 6) AS h999
    FROM (SELECT {KEY}, max({RGB}) AS direct FROM ({A.SAMPLES_SQL}) GROUP BY ALL) m
    JOIN ({top_sql(LUM_SQL, 1.0)}) a USING (clip_id, frame_idx) JOIN ({top_sql(LUM_SQL, 0.1)}) b USING (clip_id, frame_idx)""")
def a11(spark, sf_dir):
    frames = measure.measure_frames(A.samples(spark, sf_dir))
    hist, direct = F.col("lum_hist"), F.col("peak_pq")
    picks = {"direct": "max", "h99": "histogram99", "h999": "histogram999"}
    return frames.select(*FRAME, *[six(E.select_peak_pq(hist, direct, source), name) for name, source in picks.items()])


@query("a12_mean_from_histogram", f"SELECT {KEY}, round(sum(bin / 255.0::DOUBLE * n) / sum(n), 6) AS avg_pq FROM ({LUM_SQL}) GROUP BY ALL")
def a12(spark, sf_dir):
    return _dense_lum(spark, sf_dir).select(*FRAME, six(E.mean_from_hist(F.col("lum_hist")), "avg_pq"))


@query("f14_full_range_measure", f"""
    SELECT {KEY}, bin, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {KEY}), 6) AS pct, round(peak_pq, 6) AS peak_pq, round(avg_pq, 6) AS avg_pq
    FROM (SELECT {KEY}, least(round(y_code / 1023.0::DOUBLE * 255), 255)::INT AS bin, count(*) AS n FROM ({A.SAMPLES_SQL}) GROUP BY ALL)
    JOIN (SELECT {KEY}, max(y_code) / 1023.0::DOUBLE AS peak_pq, avg(y_code) / 1023.0::DOUBLE AS avg_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL) USING (clip_id, frame_idx)""")
def f14(spark, sf_dir):
    out = measure.full_range_measure(A.samples(spark, sf_dir))
    return out.select(*FRAME, "bin", "n", *[six(F.col(c), c) for c in ("pct", "peak_pq", "avg_pq")])


@query("measured_frames", f"""
    SELECT m.*, round(coalesce(lo.bin, lo.top) / 4095.0::DOUBLE, 6) AS min_pq, bins, hues FROM
      (SELECT {KEY}, round(max({RGB}), 6) AS peak_pq, round(avg({LUMA}), 6) AS avg_pq, round(avg({RGB}), 6) AS avg_max_rgb_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL) m
    JOIN ({low_sql(FINE_SQL, 0.1)}) lo USING (clip_id, frame_idx)
    JOIN (SELECT {KEY}, round(sum(bin * pct), 4) AS bins FROM ({LUM_PCT_SQL}) GROUP BY ALL) USING (clip_id, frame_idx)
    JOIN (SELECT {KEY}, round(sum(bin * 100.0::DOUBLE) / count(*), 4) AS hues FROM (SELECT {KEY}, {A.sql_hue_bin()} AS bin FROM ({A.SAMPLES_SQL})) WHERE bin IS NOT NULL GROUP BY ALL) USING (clip_id, frame_idx)""")
def measured_frames(spark, sf_dir):
    def centre(column):
        return F.round(F.aggregate(F.transform(column, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v), 4)

    frames = measure.measure_frames(A.samples(spark, sf_dir))
    values = ("peak_pq", "avg_pq", "avg_max_rgb_pq", "min_pq")
    return frames.select(*FRAME, *[six(F.col(c), c) for c in values], centre("lum_hist").alias("bins"), centre("hue_hist").alias("hues"))


# Grain ------------------------------------------------------------------------------------
DIFFS_SQL = f"""
    SELECT {KEY}, y, x, least(greatest(code, before) >> 8, 15)::INT AS band, least(abs(code - before), 63)::INT AS diff FROM (
      SELECT *, lag(code) OVER (PARTITION BY {KEY}, y ORDER BY x) AS before FROM (
        SELECT {KEY}, x, y, {RGB_CODE} AS code FROM ({CROPPED_SQL}) WHERE x = greatest(x - x % 2, rx))) WHERE before IS NOT NULL"""
MOSAIC_FINE_SQL = f"SELECT {KEY}, {RGB_CODE} AS bin, count(*) AS n FROM ({CROPPED_SQL}) GROUP BY ALL"


def mosaic_parts(spark, sf_dir):
    given, crops = A.mosaic(spark, sf_dir), A.mosaic_crops(spark, sf_dir)
    inside = S.crop_samples(given, crops)
    diffs = grain.diff_histogram(grain.cross_quad_diffs(given, crops))
    raw = measure.frame_levels(inside).select(*FRAME, F.col("max_rgb").alias("raw_max_pq"))
    return measure.fine_histogram(inside), diffs, raw


@query("w10_cross_quad_diffs", DIFFS_SQL)
def w10(spark, sf_dir):
    return grain.cross_quad_diffs(A.mosaic(spark, sf_dir), A.mosaic_crops(spark, sf_dir))


@query("a26_diff_histogram", f"SELECT {KEY}, band, diff, count(*) AS n FROM ({DIFFS_SQL}) GROUP BY ALL")
def a26(spark, sf_dir):
    return grain.diff_histogram(grain.cross_quad_diffs(A.mosaic(spark, sf_dir), A.mosaic_crops(spark, sf_dir)))


# Thirty frames taken as one hold enough pairs for the estimator at every scale; a sample's max-RGB
# and luma codes stand in for two neighbouring sites.
COARSE_SQL = f"SELECT * REPLACE ((frame_idx // 30)::INT AS frame_idx) FROM ({A.SAMPLES_SQL})"
COARSE_FINE_SQL = f"SELECT {KEY}, {RGB_CODE} AS bin, count(*) AS n FROM ({COARSE_SQL}) GROUP BY ALL"
PAIRS_SQL = f"""
    SELECT {KEY}, least(greatest(code, other) >> 8, 15)::INT AS band, least(abs(code - other) // 32, 63)::INT AS diff, count(*) AS n FROM (
      SELECT {KEY}, {RGB_CODE} AS code, round({LUMA} * 4095)::INT AS other FROM ({COARSE_SQL})) GROUP BY ALL"""
def sigma_sql(pairs: str, fine: str) -> str:
    return f"""
    WITH pairs AS ({pairs}), top AS (SELECT {KEY}, least(bin >> 8, 15)::INT AS peak_band FROM ({high_sql(fine, 99.5)})),
    merged AS (SELECT {KEY}, b.band, diff, sum(n)::BIGINT AS n FROM pairs p JOIN top USING (clip_id, frame_idx)
               JOIN (SELECT range::INT AS band FROM range(16)) b ON p.band IN (b.band, b.band - 1) WHERE b.band <= peak_band GROUP BY ALL),
    ranked AS (SELECT *, sum(n) OVER (PARTITION BY {KEY}, band ORDER BY diff) AS cum, sum(n) OVER (PARTITION BY {KEY}, band) AS total FROM merged),
    medians AS (SELECT {KEY}, band, min(diff) AS med FROM ranked WHERE total >= 500 AND cum >= (total + 1) // 2 GROUP BY ALL)
    SELECT {KEY}, coalesce(max_by(med, band) / (sqrt(2) * 0.6745) / 4095.0::DOUBLE, 0.0) AS sigma_pq FROM top LEFT JOIN medians USING (clip_id, frame_idx) GROUP BY ALL"""


SIGMA_SQL = sigma_sql(PAIRS_SQL, COARSE_FINE_SQL)


def _coarse(spark, sf_dir):
    return A.samples(spark, sf_dir).withColumn("frame_idx", F.expr("frame_idx div 30").cast("int"))


def _pairs(spark, sf_dir):
    leveled = measure.with_levels(_coarse(spark, sf_dir))
    code, other = T.fine_bin("rgb"), T.fine_bin("luma")
    return leveled.groupBy(
        *FRAME,
        F.least(F.shiftright(F.greatest(code, other), 8), F.lit(15)).alias("band"),
        F.least(F.floor(F.abs(code - other) / 32), F.lit(63)).cast("int").alias("diff"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("e1_grain_sigma", f"SELECT {KEY}, round(sigma_pq, 8) AS sigma_pq FROM ({SIGMA_SQL})")
def e1(spark, sf_dir):
    fine = measure.fine_histogram(_coarse(spark, sf_dir))
    return grain.grain_sigma(_pairs(spark, sf_dir), fine).withColumn("sigma_pq", F.round("sigma_pq", 8))


_RAW = f"SELECT {KEY}, max({RGB}) AS raw_max_pq FROM ({A.SAMPLES_SQL}) GROUP BY ALL"
_SIGMA = "((frame_idx % 7) * 0.004::DOUBLE)"


def tail_sql(fine: str, raw: str) -> str:
    """Tail counts; ``raw`` has raw_max_pq and sigma_pq."""
    return f"""
    SELECT {KEY}, raw_max_pq, sigma_pq, sum(n)::BIGINT AS total,
           coalesce(sum(CASE WHEN bin >= round(least(greatest(raw_max_pq - 2 * sigma_pq, 0), 1) * 4095) THEN n END), 0)::BIGINT AS n_eff
    FROM ({fine}) JOIN ({raw}) USING (clip_id, frame_idx) GROUP BY ALL"""


TAIL_SQL = tail_sql(FINE_SQL, f"SELECT *, {_SIGMA} AS sigma_pq FROM ({_RAW})")


def _tail_inputs(spark, sf_dir):
    given = A.samples(spark, sf_dir)
    raw = measure.frame_levels(given).select(*FRAME, F.col("max_rgb").alias("raw_max_pq"))
    sigma = raw.select(*FRAME, ((F.col("frame_idx") % 7) * F.lit(0.004)).alias("sigma_pq"))
    return measure.fine_histogram(given), raw, sigma


@query("e2_effective_tail", f"SELECT {KEY}, n_eff FROM ({TAIL_SQL})")
def e2(spark, sf_dir):
    return grain.effective_tail(*_tail_inputs(spark, sf_dir))


def _expected_sql(n: str) -> str:
    return (
        f"(CASE WHEN {n} <= 1 THEN 0.0::DOUBLE ELSE sqrt(2 * ln({n})) - (ln(ln({n})) + ln(4 * pi())) / (2 * sqrt(2 * ln({n}))) END)"
    )


def _tail_of_sql(n: str) -> str:
    z = f"greatest({_expected_sql(n)} - 2, 0)"
    t = f"(1.0::DOUBLE / (1 + 0.2316419::DOUBLE * {z}))"
    poly = f"{t} * (0.31938153::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"({n} * ({poly}) * exp(-0.5 * {z} * {z}) / sqrt(2 * pi()))"


# The predicted tail grows with the support, so the bisection finds the smallest support that reaches it.
def support_sql(tails: str) -> str:
    return f"""
    WITH RECURSIVE bis AS (
      SELECT {KEY}, n_eff, greatest(n_eff, 2) AS low, greatest(total, n_eff, 2) AS high FROM ({tails})
      UNION ALL
      SELECT {KEY}, n_eff, CASE WHEN {_tail_of_sql('(low + (high - low) // 2)')} < n_eff THEN low + (high - low) // 2 + 1 ELSE low END,
             CASE WHEN {_tail_of_sql('(low + (high - low) // 2)')} < n_eff THEN high ELSE low + (high - low) // 2 END
      FROM bis WHERE low < high)
    SELECT {KEY}, (CASE WHEN n_eff <= 1 THEN n_eff ELSE low END)::BIGINT AS support FROM bis WHERE low >= high"""


SUPPORT_SQL = support_sql(TAIL_SQL)


@query("e5_support_count", SUPPORT_SQL)
def e5(spark, sf_dir):
    fine, raw, sigma = _tail_inputs(spark, sf_dir)
    tails = grain.effective_tail(fine, raw, sigma)
    totals = fine.groupBy(*FRAME).agg(F.sum("n").alias("total"))
    return tails.join(totals, FRAME).select(*FRAME, E.support_count(F.col("n_eff"), F.col("total")).alias("support"))


def robust_sql(fine: str, tails: str) -> str:
    return f"""
    SELECT t.clip_id, t.frame_idx, raw_max_pq, sigma_pq, n_eff, h.bin / 4095.0::DOUBLE AS percentile_pq, CASE WHEN sigma_pq < 0.25 / 4095 OR n_eff <= 1 THEN raw_max_pq ELSE
        least(greatest(raw_max_pq - least(sigma_pq * {_expected_sql('support')}, 4 * sigma_pq),
                       least(greatest(h.bin / 4095.0::DOUBLE - 3.719016485455709::DOUBLE * sigma_pq, 0), raw_max_pq)), raw_max_pq) END AS robust_pq
    FROM ({tails}) t JOIN ({support_sql(tails)}) s USING (clip_id, frame_idx) JOIN ({high_sql(fine, 99.99)}) h USING (clip_id, frame_idx)"""


@query("e6_robust_peak", f"SELECT {KEY}, round(robust_pq, 6) AS robust_pq FROM ({robust_sql(FINE_SQL, TAIL_SQL)})")
def e6(spark, sf_dir):
    return grain.robust_peak(*_tail_inputs(spark, sf_dir)).withColumn("robust_pq", F.round("robust_pq", 6))


@query("e7_peak_stats", f"""
    SELECT r.clip_id, r.frame_idx, round(coalesce(h.bin, h.bottom) / 4095.0::DOUBLE, 6) AS selected_pq, round(raw_max_pq, 6) AS raw_max_pq,
           round(coalesce(h.bin, h.bottom) / 4095.0::DOUBLE, 6) AS percentile_pq, round(sigma_pq, 8) AS sigma_pq
    FROM (SELECT {KEY}, max({RGB}) AS raw_max_pq FROM ({COARSE_SQL}) GROUP BY ALL) r JOIN ({high_sql(COARSE_FINE_SQL, 99.99)}) h USING (clip_id, frame_idx) JOIN ({SIGMA_SQL}) s USING (clip_id, frame_idx)""")
def e7(spark, sf_dir):
    given = _coarse(spark, sf_dir)
    raw = measure.frame_levels(given).select(*FRAME, F.col("max_rgb").alias("raw_max_pq"))
    fine = measure.fine_histogram(given)
    stats = measure.peak_stats(fine, raw, _pairs(spark, sf_dir), "percentile")
    return stats.select(
        *FRAME, *[six(F.col(c), c) for c in ("selected_pq", "raw_max_pq", "percentile_pq")], F.round("sigma_pq", 8).alias("sigma_pq")
    )


MOSAIC_TAILS = tail_sql(
    MOSAIC_FINE_SQL,
    f"SELECT * FROM (SELECT {KEY}, max({RGB}) AS raw_max_pq FROM ({CROPPED_SQL}) GROUP BY ALL) JOIN ({sigma_sql(f'SELECT {KEY}, band, diff, count(*) AS n FROM ({DIFFS_SQL}) GROUP BY ALL', MOSAIC_FINE_SQL)}) USING (clip_id, frame_idx)",
)


@query("e7_peak_stats_robust", f"""
    SELECT {KEY}, round(robust_pq, 6) AS selected_pq, round(raw_max_pq, 6) AS raw_max_pq, round(percentile_pq, 6) AS percentile_pq, round(sigma_pq, 8) AS sigma_pq, round(raw_max_pq - robust_pq, 6) AS correction_pq, n_eff
    FROM ({robust_sql(MOSAIC_FINE_SQL, MOSAIC_TAILS)})""")
def e7_robust(spark, sf_dir):
    fine, diffs, raw = mosaic_parts(spark, sf_dir)
    stats = measure.peak_stats(fine, raw, diffs, "robust")
    return stats.select(
        *FRAME, *[six(F.col(c), c) for c in ("selected_pq", "raw_max_pq", "percentile_pq", "correction_pq")], F.round("sigma_pq", 8).alias("sigma_pq"), "n_eff"
    )


@query("e8_peak_domain", """
    SELECT clip_id, transfer, CASE WHEN transfer = 'HLG' THEN 'luma' ELSE 'max-rgb' END AS domain FROM (
      SELECT 'v' || event_id AS clip_id, (['PQ', 'HLG', 'unknown'])[event_id % 3 + 1] AS transfer FROM events)""")
def e8(spark, sf_dir):
    transfer = F.element_at(F.array(F.lit("PQ"), F.lit("HLG"), F.lit("unknown")), (F.col("event_id") % 3 + 1).cast("int"))
    clips = A.table(spark, sf_dir, "events").select(F.concat(F.lit("v"), F.col("event_id")).alias("clip_id"), transfer.alias("transfer"))
    return clips.join(measure.peak_domain(clips), "clip_id")


MEDIAN_SQL = f"""
    WITH m AS ({A.MOSAIC_LUMA_SQL}), inner_m AS (SELECT m.* FROM m JOIN ({A.MOSAIC_CROPS_SQL}) c ON m.clip_id = c.clip_id
        WHERE x > rx AND x < rx + rw - 1 AND y > ry AND y < ry + rh - 1),
    med AS (SELECT i.clip_id, i.frame_idx, i.x, i.y, list_sort(list(n.y_code))[count(*) // 2 + 1] AS med FROM inner_m i JOIN m n
        ON i.clip_id = n.clip_id AND i.frame_idx = n.frame_idx AND n.x BETWEEN i.x - 1 AND i.x + 1 AND n.y BETWEEN i.y - 1 AND i.y + 1 GROUP BY ALL)
    SELECT m.clip_id, m.frame_idx, m.x, m.y, coalesce(med, y_code)::INT AS y_code FROM m LEFT JOIN med
        ON m.clip_id = med.clip_id AND m.frame_idx = med.frame_idx AND m.x = med.x AND m.y = med.y"""


@query("w17_median3", MEDIAN_SQL)
def w17(spark, sf_dir):
    return grain.median3(A.mosaic_luma(spark, sf_dir), A.mosaic_crops(spark, sf_dir))


# The same measurement on stored planes ----------------------------------------------------
def mosaic_planes(spark, sf_dir, repeat: int = 1):
    """Planes of the mosaic, one row per frame; ``repeat`` stacks a frame on itself. The last frame may lack tiles, which are holes."""
    given = A.mosaic(spark, sf_dir)

    def placed(name, at, wanted):
        return F.sort_array(F.collect_list(F.when(wanted, F.struct(at.cast("int").alias("at"), packing.word(F.col(name)).alias("v")))))

    site = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)
    luma_at, site_at = F.col("y") * A.SIDE + F.col("x"), F.expr(f"(y div 2) * {A.SIDE // 2} + x div 2")
    rows = given.groupBy(*FRAME).agg(
        placed("y_code", luma_at, F.lit(True)).alias("luma"), placed("cb_code", site_at, site).alias("cb"), placed("cr_code", site_at, site).alias("cr")
    )
    plane = lambda name, size: F.unhex(F.repeat(packing.text(F.col(name), F.lit(size)), F.lit(repeat))).alias(name)
    return rows.select(
        *FRAME, F.lit(A.SIDE).alias("width"), F.lit(A.SIDE * repeat).alias("height"), plane("luma", A.SIDE**2), plane("cb", A.SIDE**2 // 4), plane("cr", A.SIDE**2 // 4)
    )


@query("measured_planes", f"""
    SELECT m.*, round(coalesce(lo.bin, lo.top) / 4095.0::DOUBLE, 6) AS min_pq FROM
      (SELECT {KEY}, count(*) AS n, round(max({RGB}), 6) AS peak_pq, round(avg({LUMA}), 6) AS avg_pq, round(avg({RGB}), 6) AS avg_max_rgb_pq FROM ({CROPPED_SQL}) GROUP BY ALL) m
    JOIN ({low_sql(MOSAIC_FINE_SQL, 0.1)}) lo USING (clip_id, frame_idx)""")
def measured_planes(spark, sf_dir):
    frames = planes.measure_planes(mosaic_planes(spark, sf_dir), crops=A.mosaic_crops(spark, sf_dir))
    return frames.select(*FRAME, "n", *[six(F.col(c), c) for c in ("peak_pq", "avg_pq", "avg_max_rgb_pq", "min_pq")])


@query("a26_diff_histogram_planes", f"SELECT {KEY}, band, diff, count(*) AS n FROM ({DIFFS_SQL}) GROUP BY ALL")
def a26_planes(spark, sf_dir):
    return planes.plane_diffs(mosaic_planes(spark, sf_dir), crops=A.mosaic_crops(spark, sf_dir))


@query("a2_hue_histogram_planes", f"""
    SELECT {KEY}, bin, n FROM (SELECT l.clip_id, frame_idx, {A.sql_hue_bin()} AS bin, count(*) AS n
      FROM ({A.MOSAIC_SQL}) l JOIN ({A.MOSAIC_CROPS_SQL}) c ON l.clip_id = c.clip_id
      WHERE x % 2 = 0 AND y % 2 = 0 AND x // 2 >= rx // 2 AND x // 2 < rx // 2 + rw // 2 AND y // 2 >= ry // 2 AND y // 2 < ry // 2 + rh // 2
      GROUP BY ALL) WHERE bin IS NOT NULL""")
def a2_planes(spark, sf_dir):
    stats = planes.plane_stats(mosaic_planes(spark, sf_dir), crops=A.mosaic_crops(spark, sf_dir))
    return stats.where(F.col("hue_bin").isNotNull()).groupBy(*FRAME, F.col("hue_bin").alias("bin")).agg(F.sum("n").alias("n"))


@query("w17_median3_planes", MEDIAN_SQL)
def w17_planes(spark, sf_dir):
    smooth = planes.median3_planes(mosaic_planes(spark, sf_dir), A.mosaic_crops(spark, sf_dir))
    return readers.samples_from_planes(smooth).select(*FRAME, "x", "y", "y_code")
