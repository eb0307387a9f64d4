"""Literal cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from lumaspark.functions import estimators as E, reshape as R, text as X, transfer as T
from single_row import one


def test_pq_codes_and_round_trip(spark):
    got = one(spark, **{f"c{n}": T.nits_to_pq_code(F.lit(n)) for n in (0, 100, 600, 1000, 10000, 20000)})
    assert (got["c100"], got["c600"], got["c1000"], got["c10000"], got["c20000"]) == (2081, 2851, 3079, 4095, 4095)
    back = one(spark, **{f"n{n}": T.pq_to_nits(T.nits_to_pq(F.lit(float(n)))) for n in (1, 100, 4000)})
    assert back["n1"] == pytest.approx(1, rel=1e-9) and back["n4000"] == pytest.approx(4000, rel=1e-9)
    assert one(spark, z=T.pq_to_nits(F.lit(-0.1)))["z"] == 0.0
    assert T.nits_to_pq_number(100.0) == pytest.approx(0.508078421517399, abs=1e-12)


def test_curves_in_the_bits_of_the_c_library(spark):
    nits = [None, math.nan, -1.0, 0.0, 0.005, 1.0, 421.0, 10000.0, 1e7, math.inf]
    odd = spark.createDataFrame([(v, (i - 3) / 2.0 if i else None) for i, v in enumerate(nits)], "nits DOUBLE, pq DOUBLE")
    got = odd.select(T.c_nits_to_pq("nits").alias("a"), T.nits_to_pq("nits").alias("b"), T.c_pq_to_nits("pq").alias("c"), T.pq_to_nits("pq").alias("d"))
    for r in got.collect():
        assert r.a == pytest.approx(r.b, rel=1e-12, nan_ok=True)
        assert r.c == pytest.approx(r.d, rel=1e-9, nan_ok=True) if r.d is not None else r.c is None
    whole = spark.range(1, 2000).select(F.col("id").cast("double").alias("n")).select("n", T.c_nits_to_pq("n").alias("pq"), T.c_pq_to_nits(T.c_nits_to_pq("n")).alias("back"))
    for r in whole.collect():
        y = math.pow(r.n / T.PEAK_NITS, T.M1)
        pq = math.pow((T.C1 + T.C2 * y) / (1.0 + T.C3 * y), T.M2)
        e = math.pow(pq, 1.0 / T.M2)
        assert (r.pq, r.back) == (pq, math.pow((e - T.C1) / (T.C2 - T.C3 * e), 1.0 / T.M1) * T.PEAK_NITS)


def test_hlg_segments(spark):
    got = one(spark, low=T.hlg_relative(F.lit(0.5)), top=T.hlg_relative(F.lit(1.0)), mid=T.hlg_to_nits(F.lit(0.75), 1000.0), over=T.hlg_to_nits(F.lit(1.0), 50000.0))
    assert got["low"] == pytest.approx(1 / 12) and got["top"] == pytest.approx(1.0, abs=1e-6)
    assert got["mid"] == pytest.approx(265, abs=1.0) and got["over"] == 10000.0


def test_bins(spark):
    got = one(
        spark, zero=T.lum_bin(F.lit(0.0)), border=T.lum_bin(F.lit(T.SDR_PEAK_PQ)), top=T.lum_bin(F.lit(1.0)), fine=T.fine_bin(F.lit(2.0)),
        red=T.hue_bin(F.lit(512), F.lit(600)), grey=T.hue_bin(F.lit(515), F.lit(515)), right=T.hue_bin(F.lit(600), F.lit(512)), turn=T.hue_bin(F.lit(600), F.lit(511)),
    )
    assert (got["zero"], got["border"], got["top"], got["fine"]) == (0, 64, 255, 4095)
    assert (got["red"], got["grey"], got["right"], got["turn"]) == (7, None, 0, 30)


def test_max_rgb_uses_unclamped_luma(spark):
    got = one(spark, grey=T.max_rgb_pq(F.lit(502), F.lit(512), F.lit(512)), dark=T.max_rgb_pq(F.lit(0), F.lit(512), F.lit(700)), hlg=T.max_rgb_pq(F.lit(700), F.lit(512), F.lit(512), "HLG"), luma=T.luma_pq(F.lit(700), "HLG"))
    assert got["grey"] == pytest.approx(0.5)
    assert got["dark"] == pytest.approx(-64 / 876 + 1.4746 * 188 / 896)
    assert got["hlg"] == got["luma"]


def test_p010_and_tags(spark):
    got = one(spark, hi=T.unpack_code(F.lit(940 << 6), "p010"), lo=T.unpack_code(F.lit(0xF000 | 64)), tag=T.transfer_of(F.lit("ARIB-STD-B67")), none=T.transfer_of(F.lit("bt709")))
    assert got == {"hi": 940, "lo": 64, "tag": "HLG", "none": "unknown"}


def entries(values):
    return F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(n).cast("bigint").alias("n")) for b, n in values])


def test_percentiles_on_counts(spark):
    fine = entries([(2, 1), (51, 998), (300, 1)])
    flat = entries([(i, 1) for i in range(10)])
    got = one(
        spark, p0=E.low_percentile_bin(fine, 0.0), p01=E.low_percentile_bin(fine, 0.1), full=E.low_percentile_bin(fine, 100.0),
        high=E.high_percentile_bin(fine, 99.99), zero=E.high_percentile_bin(fine, 0.0), mid=E.low_percentile_bin(flat, 50.0),
        empty=E.low_percentile_pq(F.slice(fine, 1, 0), 1.0),
    )
    assert got == {"p0": 2, "p01": 51, "full": 300, "high": 300, "zero": 2, "mid": 5, "empty": 0.0}


def test_knee_and_histogram_percentile(spark):
    hist = [0.0] * 256
    hist[100], hist[250], hist[255] = 98.0, 1.5, 0.5
    h = F.array(*[F.lit(v) for v in hist])
    none = F.array(*[F.lit(0.0)] * 256)
    got = one(spark, knee=E.highlight_knee_nits(h), p99=E.lum_percentile_pq(h, 99.0), no_knee=E.highlight_knee_nits(none), none=E.lum_percentile_pq(none, 99.0))
    assert got["knee"] > 1000 and got["p99"] == pytest.approx(250 / 255)
    assert got["no_knee"] == 1000.0 and got["none"] == 1.0


def test_chi_square(spark):
    a, b = F.array(F.lit(100.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(100.0))
    got = one(spark, same=E.chi_square(a, a), far=E.chi_square(a, b))
    assert got["same"] == 0.0 and got["far"] == pytest.approx(200, rel=1e-6)


def test_gaussian_support(spark):
    def expected(n):
        lead = math.sqrt(2 * math.log(n))
        return lead - (math.log(math.log(n)) + math.log(4 * math.pi)) / (2 * lead)

    def survival(z):
        return 0.5 * math.erfc(z / math.sqrt(2))

    support = 50_000
    tail = round(support * survival(expected(support) - 2))
    got = one(spark, n=E.support_count(F.lit(tail), F.lit(10_000_000)), one=E.support_count(F.lit(1), F.lit(100)), e=E.expected_gaussian_max(F.lit(support)), s=E.normal_survival(F.lit(2.0)))
    assert got["n"] == pytest.approx(support, rel=0.01) and got["one"] == 1
    assert got["e"] == pytest.approx(expected(support)) and got["s"] == pytest.approx(survival(2.0), abs=1e-6)


def test_text_functions(spark):
    hints = lambda t, m=False: X.classify_hints(F.lit(t), F.lit(m))
    got = one(
        spark, hlg=hints("BT.2020 (10-bit)\nHLG / BT.2020"), none=hints("BT.2020 (10-bit)"), pq=hints("SMPTE ST 2084", True), pq2=hints("SMPTE ST 2084"), plus=hints("hdr10+"),
        ms=X.duration_seconds(F.lit("3438032")), sec=X.duration_seconds(F.lit("3438.032")), bad=X.duration_seconds(F.lit("soon")),
        n=X.number_after(F.lit("Frames: 2908"), "Frames:"), miss=X.number_after(F.lit("no"), "Frames:"), p3=X.primaries_index(F.lit("Display P3"), F.lit("BT.2020")),
        box=X.primaries_index(F.lit(None).cast("string"), F.lit("BT.2020")), dflt=X.primaries_index(F.lit("x"), F.lit("y")),
    )
    assert (got["hlg"], got["none"], got["pq"], got["pq2"], got["plus"]) == ("hlg", None, "hdr10_with_measurements", "hdr10_unsupported", "hdr10plus")
    assert (got["ms"], got["sec"], got["bad"], got["n"], got["miss"]) == (3438.032, 3438.032, None, 2908.0, None)
    assert (got["p3"], got["box"], got["dflt"]) == (0, 2, 2)


def test_natural_order(spark):
    names = ["b10", "b9", "B09", "a2", "a10x", "a010", "b-1", "b"]
    rows = spark.createDataFrame([(n,) for n in names], "path STRING").orderBy(X.natural_key("path")).collect()
    assert [r.path for r in rows] == ["a2", "a10x", "a010", "b", "b-1", "b9", "B09", "b10"]


def curve(kind, pivots, pieces):
    big = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    rows = [F.struct(F.lit(o).alias("ord"), F.lit(c).cast("bigint").alias("constant"), F.array(*[big(r) for r in coefs]).alias("coefs")) for o, c, coefs in pieces]
    return F.struct(F.lit(kind).alias("kind"), big(pivots).alias("pivots"), F.array(*rows).alias("pieces"))


def test_reshaping_cases(spark):
    one_, d = 1 << 23, F.lit(23)
    x = F.lit(512 << 6)
    poly = lambda value, pivots, *pieces: F.shiftright(R.poly_reshape(value, curve("polynomial", pivots, pieces), d), 6)
    two = ((0, 0, [[0, one_]]), (0, 0, [[800 * one_, 0]]))
    def mmr(const, coefs):
        shaped = R.with_mmr(spark.range(1), F.lit(400 << 6), x, x, curve("mmr", (0, 1023), [(1, const, [coefs])]), d, "v")
        assert shaped.columns == ["id", "v"]
        return shaped.first().v >> 6

    got = one(
        spark, same=poly(x, (0, 1023), (0, 0, [[0, one_]])), const=poly(x, (0, 1023), (0, 0, [[256 * one_, 0]])), half=poly(x, (0, 1023), (0, 0, [[0, one_ // 2]])),
        low=poly(F.lit(256 << 6), (0, 512, 1023), *two), high=poly(F.lit(700 << 6), (0, 512, 1023), *two), quad=poly(x, (0, 1023), (1, 0, [[0, 0, one_ // 1023]])),
        clamp=poly(x, (0, 1023), (0, 0, [[2000 * one_, 0]])),
        ident=R.poly_reshape(x, curve("identity", (0, 1023), [(0, 0, [[0]])]), d),
    )
    assert (got["same"], got["const"], got["half"], got["low"], got["high"]) == (512, 256, 256, 256, 800)
    assert abs(got["quad"] - 256) <= 2 and got["clamp"] == 1023
    assert (mmr(512 * one_, [0] * 7), mmr(0, [one_] + [0] * 6), got["ident"]) == (512, 400, 512 << 6)


def test_a_curve_of_too_many_pieces_fails(spark):
    pieces = [(0, 0, [[0, 1 << 23]])] * 9
    with pytest.raises(Exception, match="more than 8 pieces"):
        one(spark, v=R.poly_reshape(F.lit(512 << 6), curve("polynomial", range(10), pieces), F.lit(23)))


def test_reshaping_runs_in_generated_code(spark):
    samples = spark.range(10).withColumn("curve", curve("mmr", (0, 1023), [(1, 5, [[1] * 7])]))
    plan = R.with_mmr(samples, F.col("id") * 64, F.col("id") * 64, F.col("id") * 64, F.col("curve"), F.lit(10), "v")._jdf.queryExecution().executedPlan().toString()
    assert all(line.lstrip(" +-").startswith("*(") for line in plan.splitlines() if "Project" in line)
