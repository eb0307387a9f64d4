"""Ranked search, spelling variants and exact top-k against plain definitions."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumaspark.llm import inner_product, ranked_search, spelling, words as W
from text_tables import documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranked(docs, items, size=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, counts in docs:
            m = 10 + 90 * sum(counts.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in wanted if t in counts)
            if s > 0:
                scored.append((-s, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:size], 1)]
    return sorted(out)


@pytest.fixture
def texts():
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)] + ["Straße", "ÄÖ", "x1", "naïve", "日本"]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rnd.choices(vocab, weight, k=rnd.randint(0, 40)))) for i in range(900)]
    rows += [(900, None), (901, ""), (902, "... !?"), (None, "w3 w4 w5"), (5, "W59 W58 w57"), (5, "W59 W58 w57"), (903, "w59 w58 w57")]
    return rows


@pytest.fixture
def asked(texts):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(texts)[1].split()[:12]) if i % 3 else f"w{i} w{59 - i}, naïve日本 w0") for i in range(20) for _ in [0] if True]
    return rows + [(20, None), (21, "never seen"), (None, "w1"), (22, "w59 w58"), (22, "W57"), (1 << 40, "straße STRASSE")]


@pytest.fixture(autouse=True)
def no_luck(monkeypatch):
    """Small windows and blocks, so that lists are cut and skipped on small tables too."""
    monkeypatch.setattr(ranked_search, "WINDOW_ROWS", 16)
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", 200)


@pytest.mark.parametrize("block_terms", [1 << 18, 40])
def test_search_equals_scoring_everything(spark, texts, asked, block_terms):
    clean = [(i, t or "") for i, t in texts]
    asked = [(i, t) for i, t in asked]
    docs = documents(spark, texts).withColumn("score", F.lit("x")).withColumn("n", F.lit(None)).repartition(3)
    items = spark.createDataFrame(asked, "item_id BIGINT, text STRING").withColumn("terms", F.lit(1))
    got = sorted(tuple(r) for r in ranked_search.search(docs, items, block_terms=block_terms).collect())
    assert got == ranked(clean, asked)


def test_search_of_nothing(spark, texts):
    items = spark.createDataFrame([(1, "w1")], "item_id BIGINT, text STRING")
    assert ranked_search.search(empty(spark), items).collect() == []
    assert ranked_search.search(documents(spark, texts), items.limit(0)).collect() == []
    assert ranked_search.search(documents(spark, [(1, None), (2, "")]), items).collect() == []


def test_one_query_over_blocks_in_one_task():
    """The lists of a block, short and long, in every order of the blocks."""
    rng = np.random.default_rng(3)
    n, n_terms = 3000, 30
    held = rng.random((n, n_terms)) < 1 / (1 + np.arange(n_terms))
    score = np.where(held, rng.integers(1, 50, (n, n_terms)), 0)
    ids = rng.permutation(n)
    for size in (1, 10):
        best = ranked_search.Best(size)
        for a in range(0, n, 700):
            rows, found = np.nonzero(score[a : a + 700])
            ranked_search.look(ranked_search.inverted(found, rows, score[a : a + 700][rows, found]), np.arange(n_terms), ids[a : a + 700], best)
        order = np.lexsort((ids, -score.sum(axis=1)))[:size]
        assert best.scores.tolist() == score.sum(axis=1)[order].tolist() and best.ids.tolist() == ids[order].tolist()


def test_long_texts_are_cut_between_words():
    texts = ["a b", "", "x" * 50 + " yy zz " * 30, None, "-".join(f"w{i}" for i in range(200)), "y" * 90]
    pieces, rows = W.pieces(pa.array(texts), W.NON_WORD, 40)
    whole = W.words_of(pa.array(texts), W.NON_WORD)
    cut = W.words_of(pieces, W.NON_WORD)
    assert cut.hashes.tolist() == whole.hashes.tolist() and rows[cut.rows()].tolist() == whole.rows().tolist()
    assert len(pieces) > len(texts) and max(len(p.as_py()) for p in pieces) <= 95


def test_a_very_long_text_is_searched_whole(spark):
    text = "filler " * 400_000 + "needle"
    items = spark.createDataFrame([(1, "needle")], "item_id BIGINT, text STRING")
    rows = ranked_search.search(documents(spark, [(1, text), (2, "needle"), (3, "hay")]), items).collect()
    assert [r.doc_id for r in rows] == [2, 1]


def spelled(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def misspelled(rnd, word):
    at = rnd.randrange(len(word))
    kind = rnd.choice("rid")
    letter = rnd.choice("aeé")
    return word[:at] + {"r": letter + word[at + 1 :], "i": letter + word[at:], "d": word[at + 1 :]}[kind]


@pytest.mark.parametrize("large", [1, 64])
def test_spelling_equals_all_pairs(spark, monkeypatch, large):
    """With every signature group cut by halves, and with none."""
    monkeypatch.setattr(spelling, "LARGE", large)
    rnd = random.Random(11)
    base = ["running", "Straßen", "ÀÉÎÕÜßÿ", "accounting", "aaaaaaaa", "abababab", "bananaban", "letters", "setters", "short"]
    rows = []
    for i in range(400):
        chosen = [rnd.choice(base) for _ in range(30)]
        chosen += [misspelled(rnd, w) for w in chosen[:5]] + [misspelled(rnd, misspelled(rnd, w)) for w in chosen[5:8]]
        rows.append((i, " ".join(chosen)))
    rows += [(1000, None), (1001, ""), (1002, "x×y÷z 123"), (3, rows[3][1]), (None, "running RUNNING runnings runnings")]
    got = spelling.group(documents(spark, rows).withColumn("word", F.lit(1)).withColumn("key", F.lit("k")))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == spelled(rows)


def test_a_chain_of_forms(spark):
    rows = [("letterab", 3000), ("letterac", 250), ("lettexac", 20), ("letyexac", 2), ("otherword", 5)]
    docs = documents(spark, [(None, " ".join(f"{w} " * n for w, n in rows))])
    found = {r.word: (r.form, r.root) for r in spelling.group(docs).collect()}
    assert found == {
        "letterab": (None, "letterab"), "letterac": ("letterab", "letterab"), "lettexac": ("letterac", "letterab"), "letyexac": ("lettexac", "letterab"), "otherword": (None, "otherword"),
    }


def test_spelling_of_nothing_and_of_long_runs(spark):
    assert spelling.group(empty(spark)).collect() == []
    run = "ab" * 50_000
    rows = [(None, f"{run} {run} {run}c {run}c")]
    assert [r.n_near for r in spelling.group(documents(spark, rows)).collect()] == [1, 1]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING")


def top(rows, size=10):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:size], 1)]
    return sorted(out)


def search(df, **options):
    return sorted(map(tuple, inner_product.search(df, F.pmod("vec_id", F.lit(100)) == 0, **options).collect()))


@pytest.mark.parametrize("query_values", [1 << 22, 40])
def test_top_k_equals_scoring_everything(spark, monkeypatch, query_values):
    monkeypatch.setattr(inner_product, "BLOCK_VALUES", 400)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.3, size=24)).tolist(), "s") for i in range(700)]
    rows += [(700, None, ""), (701, [], ""), (800, [0.5, -0.25], ""), (702, [1.0, None], ""), (703, [float("nan")], ""), (704, [float("inf"), 1.0], ""), (None, [1.0] * 24, "")]
    rows += [rows[0], (100, [0.0] * 24, ""), (5, rows[6][1], ""), (900, [0.0] * 24, "")]
    assert search(vectors(spark, rows).repartition(3), query_values=query_values) == top(rows)


def test_top_k_of_few_and_of_large_vectors(spark):
    assert search(vectors(spark, [])) == []
    assert search(vectors(spark, [(0, [1.0], "")])) == []
    rows = [(i, [1e5 * (i % 7 - 3), -2e5, float(i)], "") for i in range(0, 900, 50)]
    assert search(vectors(spark, rows)) == top(rows)  # beyond what a double holds
    with pytest.raises(Exception, match="64 bits"):
        search(vectors(spark, [(0, [1e14], ""), (1, [1e14], "")]))
