"""Repeated passages against a dictionary of windows, and benchmark passages against plain edit distance."""

import random

import numpy as np
import pytest
from text_tables import documents, empty, sentence, words

from lumaspark.llm import debruijn as D
from lumaspark.llm import pigeonhole as P


def without_repeats(rows, window=20):
    rows = sorted((i, (t or "").encode().split()) for i, t in rows)
    first = {}
    for i, w in rows:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = {}
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), b" ".join(kept).decode())
    return out


def mixed(seed, docs=60):
    rng = random.Random(seed)
    passages = [sentence(rng.randrange(18, 90), stem=f"p{k}_") for k in range(6)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))))
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_windows(spark, seed):
    rows = mixed(seed) + [(500, None), (501, ""), (502, "x " * 400), (503, "a b " * 60), (504, sentence(19)), (505, sentence(20)), (506, sentence(20)), (507, sentence(15_000))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in D.remove(documents(spark, rows)).collect()}
    assert got == without_repeats(rows)


def test_rows_of_one_id_and_null_ids(spark):
    rows = [(1, sentence(30)), (1, sentence(30)), (None, sentence(30)), (2, sentence(30))]
    got = sorted(((r.doc_id, r.n_removed) for r in D.remove(documents(spark, rows)).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 30), (None, 0)]


def test_spans_name_their_source(spark):
    rows = [(1, sentence(100)), (2, "lead " + sentence(100) + " tail"), (3, sentence(50, 30))]
    got = {tuple(r) for r in D.repeats(documents(spark, rows)).select("doc", "start", "words", "source_doc", "source_start").collect()}
    assert {r[0] for r in got} == {2, 3}
    for doc, start, n, source, at in got:
        a, b = words(rows[doc - 1][1]), words(rows[source - 1][1])
        assert a[start : start + n] == b[at : at + n]


def test_empty_documents(spark):
    assert D.remove(empty(spark)).count() == 0
    assert P.find(empty(spark), spark.createDataFrame([(1, "a b")], "item_id BIGINT, text STRING")).count() == 0


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance_equals_the_table():
    rng = np.random.default_rng(3)
    for m in (1, 5, 63, 64, 65, 130):
        for _ in range(20):
            pattern, text = rng.integers(0, 4, m), rng.integers(0, 4, rng.integers(0, 200))
            assert P.myers(pattern, text) == plain_distance(pattern.tolist(), text.tolist())


def test_passages_within_the_budget_are_found(spark):
    rng = random.Random(4)
    items = [(k, sentence(rng.randrange(8, 60), stem=f"i{k}q")) for k in range(10)] + [(90, "Short one, here"), (91, None), (92, ""), (93, "Short one here")]
    rows, want = [], {}
    for i in range(80):
        k = rng.randrange(10)
        w = items[k][1].split()
        e = rng.randrange(0, P.budget(len(w)) + 3)
        for p in rng.sample(range(len(w)), e):
            w[p] = f"x{i}q{p}"
        rows.append((i, f"Noise, {sentence(30, stem=f'n{i}q')}. " + ", ".join(w).upper() + f"\n{sentence(5, stem='t')}"))
        want[i] = {k} if plain_distance(words(items[k][1]), [x.lower().strip(",") for x in words(rows[-1][1])])[0] <= P.budget(len(items[k][1].split())) else set()
    rows += [(100, None), (101, ""), (102, "say SHORT one\nhere now"), (103, "short one was here")]
    want |= {100: set(), 101: set(), 102: {90, 93}, 103: set()}
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    for block in (P.BLOCK_CHARS, 400):  # one block, and several
        got = {r.doc_id: {x.item_id for x in r.leaks} for r in P.find(documents(spark, rows), bench, block_chars=block).collect()}
        assert got == want


def test_span_of_a_leak_and_repeated_rows(spark):
    item = sentence(20)
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id BIGINT, text STRING")
    docs = documents(spark, [(1, "a b c " + item + " d"), (1, "a b c " + item + " d")])
    for r in P.find(docs, bench).collect():
        assert sorted((x.item_id is None, x.distance, x.start, x.stop) for x in r.leaks) == [(False, 0, 3, 23), (True, 0, 3, 23)]
    assert [r.leaks for r in P.find(docs, bench.where("item_id = 1")).collect()] == [[], []]
