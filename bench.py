"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results are
written to Spark's no-op sink, so every column of every row is computed. The planes pass
measures a stored table of full-size frames that Spark derives from the embeddings table;
writing that table is not part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from lumaspark.operators import planes  # noqa: E402
from lumaspark.plans.analyze import Options, analyze_frames, measure_samples  # noqa: E402
from lumaspark.session import local_session, stage_dir, staged  # noqa: E402
from lumaspark.workbench import adapters as A, ordered as W, pixels, registry  # noqa: E402

HEADLINES = (
    "measured_frames", "a1_lum_histogram", "a3_fine_histogram", "w10_cross_quad_diffs", "w17_median3", "c1_detect_crop", "e6_robust_peak",
    "w1_histogram_distance", "w4_accept_cuts", "w9_smoothing_pass", "w14_delta_limit", "w15_smooth_targets", "w18_optimizer_pass",
    "a13_max_cll", "a17_scene_l1", "a19_error_stats", "a22_health_report", "m4_static_metadata", "f20_mmr_reshape", "j8_composite", "flagship_headers", "flagship_targets",
)
RUNS = 3
STACK = 5184  # 40 x 40 mosaics stacked to the sample count of a 3840 x 2160 frame


def timed(run, runs: int = RUNS) -> float:
    run()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took), 3)


def drop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "lumaspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    names = [n for n in HEADLINES if not sys.argv[1:] or n.startswith(tuple(sys.argv[1:]))]
    queries = {name: timed(lambda name=name: drop(registry.QUERIES[name](spark, sf_dir))) for name in names}
    rates = {}
    if not sys.argv[1:]:
        # Frames are large: few per Arrow batch, and splits small enough to fill every core.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "6m")
        path = f"{stage_dir(spark)}/bench-planes-{uuid.uuid4().hex}"
        pixels.mosaic_planes(spark, sf_dir, STACK).repartition(cpus * 3).write.parquet(path)
        stored = spark.read.parquet(path)
        samples = stored.agg(F.sum(F.col("width") * F.col("height"))).first()[0]
        queries["planes_pass"] = timed(lambda: drop(planes.measure_planes(stored)), 2)
        rates["planes_samples_per_sec"] = round(samples / queries["planes_pass"])
        rates["planes_fps_at_2160p"] = round(samples / queries["planes_pass"] / (3840 * 2160), 2)
        given = A.samples(spark, sf_dir)
        rates["long_samples_per_sec"] = round(given.count() / queries["measured_frames"])
        framed = staged(measure_samples(given, None, Options()), "bench-frames")
        began = time.perf_counter()
        drop(analyze_frames(framed, Options(scene_threshold=W.THRESHOLD)).frames)
        rates["analysis_frames_per_sec"] = round(framed.count() / (time.perf_counter() - began), 1)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "rates": rates, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
