"""Results that hang on the last bit of a double: whole nits after a round trip through PQ, and means at one half."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lumaspark.workbench import audit


def events(path, rows):
    """A table of events from rows of event_id, user_id and value, with k 0."""
    ids, users, values = (list(c) for c in zip(*rows))
    pq.write_table(pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array([0] * len(ids), pa.timestamp("us")), "user_id": pa.array(users, pa.int64()),
        "event_type": ["view"] * len(ids), "value": pa.array(values, pa.float64()), "props": ['{"k": 0}'] * len(ids),
    }), f"{path}/events.parquet")
    return str(path)


def sql_rows(path, name, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return sorted(con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", ["a16_scene_stats", "w13_raw_target", "a14_fall", "a15_headers"])
def test_whole_peaks_are_cut_as_in_the_sql(spark, tmp_path, name):
    # Every frame is a scene of its own, and its peak plus a quarter is a whole number of nits.
    path = events(tmp_path, [(5600 * i, 1, i + 0.75) for i in range(1200)])
    got = entry.queries()[name](spark, path)
    assert sorted(map(tuple, got.collect())) == sql_rows(path, name, got.columns)


def halves(seed):
    """Values of two decimals whose mean is a whole number and a half."""
    rng = random.Random(seed)
    cents = [rng.randrange(20000) for _ in range(9)]
    cents.append(10 * (100 * (sum(cents) // 1000) + 50) - sum(cents) + 1000)
    return [c / 100 for c in cents]


def test_means_at_one_half_do_not_hang_on_the_order(spark, tmp_path):
    """Base and current run may meet the rows of a user in two orders; their difference may not show it."""
    users = {seed: halves(seed) for seed in range(300)}
    got, deltas = [], []
    for way in (list, sorted, lambda v: sorted(v, reverse=True)):
        folder = tmp_path / str(len(got))
        folder.mkdir()
        path = events(folder, [(i, u, v) for u, values in users.items() for i, v in enumerate(way(values))])
        got.append({r.name: r.maxfall for r in audit._run(spark, path, audit.F.lit("user"), 1).collect()})
        deltas += [(int(r.name[4:-4]) % 7, r.maxfall_delta) for r in entry.queries()["j7_header_deltas"](spark, path).collect()]
    exact = {f"user{u}.bin": (round(sum(round(v * 100) for v in values) / 10) + 50) // 100 for u, values in users.items()}
    assert got[0] == got[1] == got[2] == exact
    assert all(shift == delta for shift, delta in deltas)


def test_means_of_odd_values(spark, tmp_path):
    rows = [(0, 1, None), (1, 2, 1e300), (2, 2, 3e300), (3, 3, 1e-30), (4, 3, 2.5), (5, 4, -2.5), (6, 4, None), (7, 6, 7.0)]
    path = events(tmp_path, rows)
    means = {r.user_id: r.mean for r in spark.read.parquet(f"{path}/events.parquet").groupBy("user_id").agg(audit._mean("value").alias("mean")).collect()}
    assert means == {1: None, 2: 2e300, 3: 1.25, 4: -2.5, 6: 7.0}
