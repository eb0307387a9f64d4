"""Chunked operators against plain loops, with chunks small enough to be crossed many times."""

import random

import pytest
from pyspark.sql import functions as F

from lumaspark.operators import ordered as O

CHUNK = 8
KEYS = ["clip_id"]


@pytest.fixture(scope="module")
def series():
    rng = random.Random(11)
    # One clip holds most rows; another is shorter than a chunk.
    return {clip: [(i, rng.random(), rng.randrange(0, 400), rng.random() < 0.35) for i in range(n)] for clip, n in (("a", 150), ("b", 5), ("c", 33))}


@pytest.fixture(scope="module")
def table(spark, series):
    rows = [(clip, *row, len(values)) for clip, values in series.items() for row in values]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "clip_id STRING, frame_idx INT, x DOUBLE, v INT, hit BOOLEAN, len INT").repartition(3)


def by_key(df, column):
    out = {}
    for row in df.select("clip_id", "frame_idx", column).collect():
        out.setdefault(row[0], {})[row[1]] = row[2]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("weight", [0.1, 0.5, 0.97, 1.0])
@pytest.mark.parametrize("start", ["first", "zero"])
def test_ema(table, series, weight, start):
    got = by_key(O.ema(table, KEYS, "frame_idx", {"x": "s"}, weight, start, CHUNK), "s")
    for clip, rows in series.items():
        state = rows[0][1] if start == "first" else 0.0
        for i, row in enumerate(rows):
            if weight == 1.0:
                state = row[1]
            elif i or start == "zero":
                state = weight * row[1] + (1 - weight) * state
            assert got[clip][i] == pytest.approx(state, rel=1e-11)


def test_ema_both_directions(table, series):
    out = O.ema(table, KEYS, "frame_idx", {"x": "f"}, 0.2, "first", CHUNK, {"x": "b"}, "len")
    forward, backward = by_key(out, "f"), by_key(out, "b")
    for clip, rows in series.items():
        for values, got in (([r[1] for r in rows], forward[clip]), ([r[1] for r in rows][::-1], backward[clip][::-1])):
            state = values[0]
            for i, x in enumerate(values):
                state = x if i == 0 else 0.2 * x + 0.8 * state
                assert got[i] == pytest.approx(state, rel=1e-11)


@pytest.mark.parametrize("step", [5, 60, 500])
@pytest.mark.parametrize("bounds", [None, (0, 400)])
def test_limit_steps(table, series, step, bounds):
    got = by_key(O.limit_steps(table, KEYS, "frame_idx", "v", "p", step, CHUNK, bounds), "p")
    for clip, rows in series.items():
        state = rows[0][2]
        for i, row in enumerate(rows):
            state = max(state - step, min(state + step, row[2]))
            assert got[clip][i] == state


def test_limit_steps_rejects_values_outside_the_bounds(table):
    with pytest.raises(Exception, match="lies outside"):
        O.limit_steps(table, KEYS, "frame_idx", "v", "p", 5, CHUNK, (0, 100)).collect()


@pytest.mark.parametrize("gap", [3, 7, 20])
def test_greedy_cuts(table, series, gap):
    got = {}
    for row in O.greedy_cuts(table, KEYS, "frame_idx", F.col("hit"), gap, CHUNK).collect():
        got.setdefault(row[0], []).append(row[1])
    for clip, rows in series.items():
        last, want = 0, []
        for i, *_x, hit in rows:
            if hit and i - last >= gap:
                want.append(i)
                last = i
        assert sorted(got.get(clip, [])) == want


def test_greedy_cuts_over_empty_chunks(spark):
    marks = {"a": [3, 90, 95, 101, 260, 262, 283], "b": [200], "c": [24, 47, 48]}
    rows = [(c, i) for c, values in marks.items() for i in values]
    df = spark.createDataFrame(rows, "clip_id STRING, frame_idx INT")
    got = {}
    for row in O.greedy_cuts(df, KEYS, "frame_idx", F.lit(True), 24, 24).collect():
        got.setdefault(row[0], []).append(row[1])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [90, 260], "b": [200], "c": [24, 48]}


def test_state_scan_over_many_groups(table, series, monkeypatch):
    monkeypatch.setattr(O, "SUPER", 2)
    got = by_key(O.limit_steps(table, KEYS, "frame_idx", "v", "p", 20, 4), "p")
    for clip, rows in series.items():
        state = rows[0][2]
        for i, row in enumerate(rows):
            state = max(state - 20, min(state + 20, row[2]))
            assert got[clip][i] == state


def test_windows_counts_and_carries(table, series):
    holes = table.withColumn("h", F.when(F.col("hit"), F.col("v")))
    mean = by_key(O.halo_window(table, KEYS, "frame_idx", 4, {"m": lambda w: F.avg("x").over(w.rowsBetween(-4, 0))}, CHUNK), "m")
    wide = by_key(O.halo_window(table, KEYS, "frame_idx", 20, {"m": lambda w: F.count("x").over(w.rowsBetween(-20, 0))}, CHUNK), "m")
    count = by_key(O.running_count(table, KEYS, "frame_idx", F.col("hit").cast("int"), "n", CHUNK), "n")
    held = by_key(O.hold_last(holes, KEYS, "frame_idx", ["h"], CHUNK), "h")
    sparse = table.where("hit")
    before = by_key(O.previous_row(sparse, KEYS, "frame_idx", {"v": "p"}, CHUNK), "p")
    for clip, rows in series.items():
        xs, n, last, seen = [r[1] for r in rows], 0, None, []
        for i, (_, _, v, hit) in enumerate(rows):
            assert mean[clip][i] == pytest.approx(sum(xs[max(0, i - 4):i + 1]) / len(xs[max(0, i - 4):i + 1]))
            assert wide[clip][i] == min(i + 1, 21)
            n += hit
            last = v if hit else last
            assert count[clip][i] == n and held[clip][i] == last
            if hit:
                seen.append(v)
        assert before.get(clip, []) == [None, *seen][:len(seen)]


PICKS = {"low": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "p95": lambda n: F.least(F.floor(n * F.lit(0.95)), n - 1), "top": lambda n: n - 1}


@pytest.mark.parametrize("most", [1, 7, 1 << 16])
def test_pick_by_index_with_heavy_ties(spark, most):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    values = {
        "a": [0.0] * 400 + [rng.random() * 50 for _ in range(300)], "b": [7.5] * 3, "c": [1e-9 * i for i in range(50)] + [1e6],
        "d": [-inf] * 30 + [rng.gauss(0, 1) for _ in range(40)] + [inf] * 60, "e": [1.0] + [nan] * 5, "f": [nan],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "clip_id STRING, e DOUBLE")
    got = {r.clip_id: r for r in O.pick_by_index(df, KEYS, "e", PICKS, most).collect()}
    assert set(got) == set(values)
    for clip, row in got.items():
        ordered = sorted(values[clip], key=lambda v: (v != v, v))
        n = len(ordered)
        want = (ordered[0], ordered[n // 2], ordered[min(int(n * 0.95), n - 1)], ordered[-1])
        assert repr((row.low, row.mid, row.p95, row.top)) == repr(want)


def test_pick_by_index_of_whole_numbers_and_beyond_the_end(spark):
    df = spark.createDataFrame([("a", (1 << 60) + i) for i in range(40)] + [("b", None)], "clip_id STRING, e BIGINT")
    picks = {"third": lambda n: n * 0 + 3, "none": lambda n: n + 5}
    for most in (2, 1 << 16):
        assert [tuple(r) for r in O.pick_by_index(df, KEYS, "e", picks, most).collect()] == [("a", (1 << 60) + 3, None)]


def test_one_far_value_leaves_no_task_with_all_rows(spark):
    """Ten million distinct values and one of 1e300: what any task after the scans reads stays a small share."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("a").alias("clip_id"), F.when(F.col("id") == 5, 1e300).otherwise(F.xxhash64("id") % 1_000_000_007 + F.col("id") / n).alias("e"))
    seen = tasks_read(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        row = O.pick_by_index(df, KEYS, "e", {"mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    heaviest = max(records for stage, records in tasks_read(spark).items() if stage not in seen)
    assert row.top == 1e300
    assert df.where(F.col("e") < row.mid).count() == n // 2
    assert 0 < heaviest < n / 50


def tasks_read(spark):
    """Most records that one task of each finished stage read from a shuffle."""
    context = spark.sparkContext._jsc.sc()
    store, gateway = context.statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    out = {}
    for i in range(stages.size()):
        stage = stages.apply(i)
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
        reads = [tasks.apply(j).taskMetrics() for j in range(tasks.size())]
        out[stage.stageId()] = max([m.get().shuffleReadMetrics().recordsRead() for m in reads if m.isDefined()], default=0)
    return out
