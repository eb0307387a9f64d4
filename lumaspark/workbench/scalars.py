"""Scalar functions on the samples and series of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import estimators as E
from ..functions import text as X
from ..functions import transfer as T
from . import adapters as A
from .registry import query

TAGS = ("smpte2084", "bt2020-10", "bt2020-12", "arib-std-b67", "bt709")


def _on(name: str, source, source_sql: str, keys: list[str], spark_column: Callable, sql_column: str) -> None:
    """Register one projection over a whole adapter table."""

    def run(spark, sf_dir) -> DataFrame:
        # Built here: columns need a running session, the registry must load without one.
        built = spark_column()
        return source(spark, sf_dir).select(*keys, *(built if isinstance(built, list) else [built]))

    query(name, f"SELECT {', '.join(keys)}, {sql_column} FROM ({source_sql})")(run)


SAMPLE = ["clip_id", "frame_idx", "y_code", "cb_code", "cr_code"]
FRAME = ["clip_id", "frame_idx"]


def six(column: Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


def _samples(name: str, spark_column, sql_column: str) -> None:
    _on(name, A.samples, A.SAMPLES_SQL, SAMPLE, spark_column, sql_column)


def _series(name: str, spark_column, sql_column: str) -> None:
    _on(name, A.series, A.SERIES_SQL, FRAME, spark_column, sql_column)


_series("f1_nits_to_pq", lambda: six(T.nits_to_pq("peak_nits"), "pq"), f"round({A.sql_nits_to_pq('peak_nits')}, 6) AS pq")
_series(
    "f2_pq_to_nits",
    lambda: six(T.pq_to_nits((F.col("k") - 3) / F.lit(100.0)), "nits"),
    f"round({A.sql_pq_to_nits('((k - 3) / 100.0::DOUBLE)')}, 6) AS nits",
)
_series(
    "f3_nits_to_pq_code",
    lambda: T.nits_to_pq_code(F.col("peak_nits")).alias("code"),
    f"round({A.sql_nits_to_pq('least(greatest(peak_nits, 0), 10000)')} * 4095)::INT AS code",
)
_samples("f4_hlg_relative", lambda: six(T.hlg_relative(T.luma_signal("y_code")), "rel"), f"round({A.sql_hlg_relative('((y_code - 64) / 876.0::DOUBLE)')}, 6) AS rel")
_samples(
    "f5_hlg_to_nits",
    lambda: six(T.hlg_to_nits(T.luma_signal("y_code"), 1000.0), "nits"),
    f"round(least({A.sql_hlg_relative('((y_code - 64) / 876.0::DOUBLE)')} * 1000, 10000), 6) AS nits",
)
_HLG_LUMA = A.sql_nits_to_pq(f"least({A.sql_hlg_relative('((y_code - 64) / 876.0::DOUBLE)')} * 1000, 10000)")
_samples(
    "f6_luma_pq",
    lambda: [six(T.luma_pq("y_code"), "pq"), six(T.luma_pq("y_code", F.lit("HLG")), "hlg_pq")],
    f"round({A.sql_luma()}, 6) AS pq, round(least(greatest({_HLG_LUMA}, 0), 1), 6) AS hlg_pq",
)
_samples("f7_max_rgb_pq", lambda: six(T.max_rgb_pq("y_code", "cb_code", "cr_code"), "rgb"), f"round({A.sql_max_rgb()}, 6) AS rgb")
_series("f8_pq12", lambda: T.pq12(T.nits_to_pq("avg_nits")).alias("code"), f"{A.sql_pq12(A.sql_nits_to_pq('avg_nits'))} AS code")
_samples("f9_fine_bin", lambda: T.fine_bin(T.luma_pq("y_code")).alias("bin"), f"round({A.sql_luma()} * 4095)::INT AS bin")
_samples("f10_lum_bin", lambda: T.lum_bin(T.luma_pq("y_code")).alias("bin"), f"{A.sql_lum_bin(A.sql_luma())} AS bin")
_samples("f11_hue_bin", lambda: T.hue_bin("cb_code", "cr_code").alias("bin"), f"{A.sql_hue_bin()} AS bin")
_samples("f12_is_non_black", lambda: T.is_non_black("y_code").alias("lit"), f"{A.sql_luma()} > 0.01 AS lit")
_series(
    "f13_gamut_peaks",
    lambda: [six(c, n) for c, n in zip(T.gamut_peaks(T.nits_to_pq("peak_nits")), ("p3", "bt709"))],
    f"round(least({A.sql_nits_to_pq('peak_nits')} * 0.99::DOUBLE, 1), 6) AS p3, round(least({A.sql_nits_to_pq('peak_nits')} * 0.95::DOUBLE, 1), 6) AS bt709",
)
def _tag():
    return F.element_at(F.array(*[F.lit(t) for t in TAGS]), (F.col("k") % 5 + 1).cast("int"))
_series(
    "f15_transfer_of",
    lambda: T.transfer_of(_tag()).alias("transfer"),
    "(['PQ', 'PQ', 'PQ', 'HLG', 'unknown'])[k % 5 + 1] AS transfer",
)
# Facts of a stream, partly missing.
def _nb():
    return F.when(F.col("k") % 3 == 0, F.col("event_id"))
def _ticks():
    return F.when(F.col("k") % 3 == 1, F.col("event_id") * 1000)
def _us():
    return F.when(F.col("k") % 2 == 1, F.col("event_id") * 41708)
_series(
    "f16_frame_count",
    lambda: X.frame_count_estimate(_nb(), _ticks(), F.lit(1.0) / F.lit(1024.0), F.lit(24000.0) / F.lit(1001.0), _us()).alias("estimate"),
    """CASE WHEN k % 3 = 0 AND event_id > 0 THEN event_id::INT
            WHEN k % 3 = 1 AND event_id > 0 THEN trunc(event_id * 1000 * (1.0::DOUBLE / 1024.0::DOUBLE) * (24000.0::DOUBLE / 1001.0::DOUBLE))::INT
            WHEN k % 2 = 1 AND event_id > 0 THEN trunc(event_id * 41708 / 1000000.0::DOUBLE * (24000.0::DOUBLE / 1001.0::DOUBLE))::INT END AS estimate""",
)
def _duration():
    return F.when(F.col("k") % 4 == 0, F.lit("n/a")).otherwise((F.col("event_id") * 37).cast("string"))
_series(
    "f17_duration_seconds",
    lambda: X.duration_seconds(_duration()).alias("seconds"),
    """CASE WHEN k % 4 = 0 THEN NULL WHEN event_id * 37 > 86400 THEN event_id * 37 / 1000.0::DOUBLE
            ELSE (event_id * 37)::DOUBLE END AS seconds""",
)
_series(
    "e3_expected_gaussian_max",
    lambda: six(E.expected_gaussian_max(F.col("event_id")), "z"),
    """round(CASE WHEN event_id <= 1 THEN 0.0::DOUBLE ELSE sqrt(2 * ln(event_id)) -
            (ln(ln(event_id)) + ln(4 * pi())) / (2 * sqrt(2 * ln(event_id))) END, 6) AS z""",
)
_series(
    "e4_normal_survival",
    lambda: six(E.normal_survival((F.col("k") - 5) / F.lit(20.0)), "q"),
    """round(list_reduce([1.330274429::DOUBLE, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0],
                  lambda a, c: a * (1.0::DOUBLE / (1 + 0.2316419 * greatest((k - 5) / 20.0::DOUBLE, 0))) + c)
            * exp(-0.5 * pow(greatest((k - 5) / 20.0::DOUBLE, 0), 2)) / sqrt(2 * pi()), 6) AS q""",
)
