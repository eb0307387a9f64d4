"""The Jaccard join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from text_tables import documents, empty, sentence, words

from lumaspark.llm import bayes_join as J
from lumaspark.llm.tasks import components, runs


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    by_text = {}
    for i, t in rows:
        if i is not None and t is not None:
            by_text.setdefault(t, []).append(i)
    texts = list(by_text)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(texts)
    sets = [shingles(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
            links[a] += len(by_text[texts[b]])
            links[b] += len(by_text[texts[a]])
    least = {}
    for k, t in enumerate(texts):
        least[find(k)] = min(least.get(find(k), by_text[t][0]), *by_text[t])
    return {i: (least[find(k)], len(by_text[t]) - 1 + links[k]) for k, t in enumerate(texts) for i in by_text[t]}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(120, stem=f"s{k}x") for k in range(3)]
    out = [(i, edited(base[i % 3], rng.randrange(6), rng)) for i in range(90)]
    out += [(100 + i, base[0]) for i in range(20)]  # exact copies
    out += [(200, None), (201, None), (202, ""), (203, ""), (204, "a b"), (205, "a\n b"), (206, " "), (207, "one two three four"), (208, sentence(20_000))]
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_links_and_classes_equal_all_pairs(spark, rows, block):
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(documents(spark, rows), block=block).collect()}
    assert len(got) == len(rows)
    assert {i: v for i, v in got.items() if i not in (200, 201)} == expected(rows)
    assert got[200] == (200, 0) and got[201] == (201, 0)


def test_null_id_repeated_rows_and_extra_columns(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(None, "x y z"), (1, "x y z"), (1, "x y z"), (2, "q r s")]).withColumn("node", F.lit(1)).withColumn("sketch", F.lit("q"))
    got = sorted((tuple(r) for r in J.join(docs).collect()), key=str)
    assert got == sorted([(None, None, None, 1, 0), (1, 1, 1, 2, 1), (1, 1, 1, 2, 1), (2, 2, 2, 1, 0)], key=str)
    kept = J.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None]


def test_empty_table(spark):
    assert J.join(empty(spark)).count() == 0
    assert J.one_per_class(empty(spark)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    need = J.least_matches()
    rng = np.random.default_rng(1)
    for n, m in need.items():
        assert (rng.binomial(n, J.THRESHOLD, 200_000) >= m).all()
    assert need[96] > 45


def test_long_unrelated_texts_have_unlike_sketches():
    texts = pa.array([sentence(100_000, start=k * 1_000_000) for k in range(3)])
    s = np.array([np.frombuffer(x["sketch"], J.VALUE) for x in J.signatures(texts).to_pylist()])
    for i, j in combinations(range(3), 2):
        assert (s[i] == s[j]).sum() <= 2


def test_blocks_are_cut_by_bytes_of_sets(spark):
    nodes = spark.range(60).selectExpr("id AS node", "unhex(repeat('00', 192)) AS sketch", "CAST(131072 AS BIGINT) AS grams")  # 1 MB of hashes each
    groups = J.placed(nodes, block_bytes=4 << 20).groupBy("key", "lo", "hi").count().collect()
    assert max(r["count"] for r in groups) < 30
    assert {r["count"] for r in J.placed(nodes.selectExpr("node", "sketch", "CAST(9 AS BIGINT) AS grams")).groupBy("key", "lo", "hi").count().collect()} == {60}


def test_links_hold_with_small_blocks_of_bytes(spark, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(documents(spark, rows), block_bytes=20_000).collect()}
    assert {i: v for i, v in got.items() if i not in (200, 201)} == expected(rows)


def test_overlaps_by_product_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, 60).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    assert J.overlaps(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u BIGINT, v BIGINT"), "test").collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_runs_stay_whole_over_batches():
    batches = [pa.record_batch([pa.array(x, pa.int64())], ["k"]) for x in ([1, 1], [1, 2], [2], [2, 2], [], [3])]
    seen = []
    for rows, cuts in runs(iter(batches), ("k",)):
        seen += [rows.column("k").to_pylist()[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert seen == [[1, 1, 1], [2, 2, 2, 2], [3]]
