"""Shape of the physical plans: what must not appear at any scale, and what must."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumaspark.operators import composite as layers_of, measure, samples as S
from lumaspark.sources import readers, writers
from lumaspark.workbench import registry, adapters as A

SAMPLE = (
    "a1_lum_histogram", "a13_max_cll", "a19_error_stats", "c1_detect_crop", "j3_attach_scene", "j5_match_cuts", "j8_composite", "j10_first_usable_after",
    "p6_frames_in_windows", "v2_scene_coverage", "w1_histogram_distance", "w4_accept_cuts", "w11_rolling_apl", "w14_delta_limit", "w16_collapse_runs", "w17_median3",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_nested_loops(spark, small, name):
    plan = plan_of(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    A.mosaic(spark, small).write.parquet(str(tmp_path / "samples"))
    chosen = readers.read_samples(spark, str(tmp_path / "samples"), ["m1"], (0, 1), (2, 2, 8, 8)).select("frame_idx", "y_code")
    plan = plan_of(chosen.groupBy("frame_idx").agg(F.max("y_code")))
    for part in ("EqualTo(clip_id,m1)", "LessThanOrEqual(frame_idx,1)", "GreaterThanOrEqual(x,2)"):
        assert part in plan
    assert "cb_code" not in plan


def test_the_pixel_pass_shuffles_bins_and_scans_once(spark, small):
    plan = plan_of(measure.measure_frames(A.samples(spark, small)))
    assert plan.count("Scan parquet") == 1 and plan.count("Expand") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    # Only bins and sums cross the first exchange: the codes end before it.
    first = plan[plan.rindex("Exchange hashpartitioning"):].split("\n")[0]
    assert "y_code" not in first


def test_every_operator_has_a_query_and_sql(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    # The optional text operators have tests of their own where SQL can't say what they do.
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(oracles)
    found = {name.split("_")[0] for name in queries}
    counts = {"s": 15, "f": 21, "p": 8, "a": 26, "j": 12, "w": 18, "e": 8, "c": 5, "o": 6, "v": 12, "m": 18, "t": 4}
    assert {f"{letter}{i}" for letter, n in counts.items() for i in range(1, n + 1)} <= found


def moved_columns(df):
    """Columns that pass an exchange by hash, by name."""
    df.collect()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    final = text.split("== Initial Plan ==")[0]
    out = set()
    for block in re.split(r"\n\n+", text):
        if re.match(r"\(\d+\) Exchange", block) and "hashpartitioning" in block:
            number = block.split(")")[0].lstrip("(")
            if f"({number})" in final:
                out |= {c.strip().split("#")[0] for c in re.search(r"Input \[\d+\]: \[(.*)\]", block)[1].split(",")}
    return out


def test_tables_by_frame_join_where_they_lie(spark, tmp_path):
    """Chroma to luma, samples into histograms, and one layer to another: no sample and no plane passes a shuffle."""
    rng = np.random.default_rng(5)
    pack = lambda n: bytearray((rng.integers(64, 940, n) << 6).astype("<u2").tobytes())
    layers = "clip_id STRING, frame_idx INT, luma BINARY, cb BINARY, cr BINARY"
    planes = [("m", i, pack(24), pack(6), pack(6)) for i in range(40)]
    curves = "ARRAY<STRUCT<kind: STRING, pivots: ARRAY<BIGINT>, pieces: ARRAY<STRUCT<ord: INT, constant: BIGINT, coefs: ARRAY<ARRAY<BIGINT>>>>>>"
    zero, same = [0, 0, 0], [("identity", [0, 1023], [])] * 3
    params = spark.createDataFrame(
        [("m", i, zero, zero, zero, zero, zero, zero, zero, 23, 10, True, same) for i in range(40)],
        f"clip_id STRING, frame_idx INT, {', '.join(f'{c} ARRAY<BIGINT>' for c in ('nlq_offset', *layers_of.NLQ_FIELDS.values()))}, denom INT, el_bits INT, disabled BOOLEAN, curves {curves}",
    )
    luma = [("m", i, x, y, 100 + x) for i in range(40) for x in range(4) for y in range(4)]
    chroma = [("m", i, cx, cy, 500 + cx, 500 + cy) for i in range(40) for cx in range(2) for cy in range(2)]
    given = {
        "base": spark.createDataFrame(planes, layers), "upper": spark.createDataFrame(planes, layers), "params": params,
        "luma": spark.createDataFrame(luma, "clip_id STRING, frame_idx INT, x INT, y INT, y_code INT"), "chroma": spark.createDataFrame(chroma, "clip_id STRING, frame_idx INT, cx INT, cy INT, cb_code INT, cr_code INT"),
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, rows in given.items():
            writers.write_by_frame(rows, f"by_frame_{name}", 4, str(tmp_path / name))
        base, upper, known, luma, chroma = readers.read_by_frame(spark, *[f"by_frame_{n}" for n in ("base", "upper", "params", "luma", "chroma")])
        sited = S.attach_chroma(luma, chroma)
        assert sited.count() == 40 * 16 and not moved_columns(sited) & {"y_code", "cb_code"}
        assert not moved_columns(measure.lum_histogram(sited)) & {"y_code", "cb_code"}
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
        assert {"y_code", "cb_code"} <= moved_columns(S.attach_chroma(luma, chroma))  # as Spark has it by default
        readers.read_by_frame(spark)
        out = layers_of.composite_planes(base, upper, known)
        assert out.count() == 40 and not moved_columns(out) & {"luma", "cb", "cr", "el_luma", "el_cb", "el_cr"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in given:
            spark.sql(f"DROP TABLE IF EXISTS by_frame_{name}")
