"""Words inside their class: against plain loops over every unit, and by what a model of the whole corpus must tell."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from text_tables import documents
from pyspark.sql import functions as F

from lumaspark.llm import inside as I
from lumaspark.llm import maxent as M

UNITS, CLASSES = 40, 3


def key(before, unit, second):
    return (before << 2 * I.BITS) | (unit << I.BITS) | second


def discount(counts):
    once, twice = (sum(n == k for n in counts) for k in (1, 2))
    return (once + I.ONCE) / (once + 2 * twice + I.MET)


def plain(tokens, masses, classes):
    """Probability of a unit in its class after two words, by weights changed one kind after the other, with every sum over all units of the class."""
    pairs, triples, contexts = defaultdict(int), defaultdict(int), defaultdict(int)
    for before, unit, second in tokens:
        pairs[before, unit] += 1
        triples[before, unit, second] += 1
        contexts[before, classes[unit], second] += 1
    groups = {(b, classes[u]) for b, u in pairs}
    less = {g: (discount([n for (b, u), n in pairs.items() if (b, classes[u]) == g]), discount([n for (b, u, _), n in triples.items() if (b, classes[u]) == g])) for g in groups}
    x1, x2 = dict.fromkeys(pairs, 1.0), dict.fromkeys(triples, 1.0)

    def shares(before, kind, second):
        w = {u: masses[u] * x1.get((before, u), 1) * x2.get((before, u, second), 1) for u in range(len(masses)) if classes[u] == kind}
        z = sum(w.values())
        return {u: v / z for u, v in w.items()}

    for _ in range(3000):
        for x, counts, which, cut in ((x1, pairs, 0, 2), (x2, triples, 1, 3)):
            expected = defaultdict(float)
            for (b, kind, s), n in contexts.items():
                for u, p in shares(b, kind, s).items():
                    expected[(b, u, s)[:cut]] += n * p
            for f, n in counts.items():
                x[f] = max(1.0, x[f] * max(n - less[f[0], classes[f[1]]][which], 0) / expected[f])
    return shares


def drawn(n=400, seed=3):
    rng = random.Random(seed)
    classes = [u % CLASSES for u in range(UNITS)]
    masses = [0.5 + rng.randrange(20) for _ in range(UNITS)]
    return [(rng.randrange(3), min(int(rng.expovariate(0.15)), UNITS - 1), rng.randrange(4)) for _ in range(n)], masses, classes


def gains(tokens, masses, classes, more=()):
    """Those of ``tokens``, which are training, and of ``more``, which are not."""
    keys = np.array([key(*t) for t in (*tokens, *more)], np.uint64)
    whole = np.bincount(classes, masses, CLASSES)
    return I.gains(keys, np.arange(len(keys)) < len(tokens), np.array(masses), np.array(classes), whole), whole


def test_gains_equal_a_plain_loop(monkeypatch):
    monkeypatch.setattr(I, "SETTLED", 1e-12)
    tokens, masses, classes = drawn(60)
    asked = [*tokens, *((b, u, s) for b in range(3) for u in range(UNITS) for s in range(4))]
    got, whole = gains(tokens, masses, classes, asked)
    shares = plain(tokens, masses, classes)
    for (b, u, s), gain in zip(asked, got[len(tokens) :], strict=True):
        assert masses[u] / whole[classes[u]] * math.exp(gain) == pytest.approx(shares(b, classes[u], s)[u], rel=1e-3)


def test_units_of_a_class_sum_to_one_and_likelihood_rises():
    tokens, masses, classes = drawn()
    asked = [(b, u, s) for b in range(4) for s in range(5) for u in range(UNITS)]
    got, whole = gains(tokens, masses, classes, asked)
    assert got[: len(tokens)].sum() > 0
    p = np.array([masses[u] / whole[classes[u]] for _, u, _ in asked]) * np.exp(got[len(tokens) :])
    for k in range(0, len(asked), UNITS):
        assert np.bincount(classes, p[k : k + UNITS], CLASSES) == pytest.approx(np.ones(CLASSES))
    rest = [i for i, (b, _, _) in enumerate(asked) if b == 3]  # a word before that no training text has
    assert got[len(tokens) :][rest] == pytest.approx(np.zeros(len(rest)), abs=1e-12)


def test_groups_do_not_hang_on_what_lies_beside_them():
    tokens, masses, classes = drawn()
    together, _ = gains(tokens, masses, classes)
    for b in range(3):
        mine = [i for i, t in enumerate(tokens) if t[0] == b]
        assert gains([tokens[i] for i in mine], masses, classes)[0] == pytest.approx(together[mine])


def test_blocks_come_back_as_they_were():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 64, 1000, dtype=np.uint64, endpoint=False)
    marks = np.sort(rng.integers(0, 300, 1000)).astype(np.uint32) << np.uint32(1) | rng.integers(0, 2, 1000).astype(np.uint32)
    part = I.parts_of(keys, keys % np.uint64(16), 7)
    seen = 0
    for k, n, data in I.packed(keys, marks, part):
        got = I.unpacked(data, n)
        assert (got[0] == keys[part == k]).all() and (got[1] == marks[part == k]).all()
        seen += n
    assert seen == 1000


def test_a_word_is_told_from_others_of_its_class(spark):
    """Every second word follows from the one before it; the words of a class occur equally often, so only weights inside the class can tell them apart."""
    rng = random.Random(6)
    said = lambda pairs: " ".join(f"l{i} r{j}" for i, j in pairs)
    rows = [(i, said([(k, k) for k in rng.sample(range(400), 100)])) for i in range(80)]
    asked = [rng.sample(range(400), 100) for _ in range(20)]
    rows += [(1000 + i, said([(k, k) for k in ks])) for i, ks in enumerate(asked)] + [(2000 + i, said([(k, (k + 1) % 400) for k in ks])) for i, ks in enumerate(asked)]
    score = {r.doc_id: r.score for r in M.score(documents(spark, rows), F.col("doc_id") >= 1000).collect()}
    assert min(score[1000 + i] - score[2000 + i] for i in range(20)) > 2 * 100  # classes alone give less than log10(11) a pair


def test_frequent_words_are_taken_together_with_those_before():
    """Against a plain loop: the words before, back to one that isn't hot; 9 stands for the beginning."""
    rng = random.Random(8)
    texts = [[rng.randrange(5) for _ in range(rng.randrange(0, 40))] for _ in range(60)] + [[0] * 30]
    first = np.cumsum([0, *(len(t) for t in texts)])
    units = np.array([u for t in texts for u in t])
    keys = I.keys_of(units, first, 9, hot=2)
    known = {}
    for key_, (t, i) in zip(keys.tolist(), ((t, i) for t in texts for i in range(len(t))), strict=True):
        back = [*t[:i][::-1], *[9] * (I.MOST_NEAR + 1)]
        n = next((k for k in range(I.MOST_NEAR - 1) if back[k] >= 2), I.MOST_NEAR - 1) + 1
        assert (key_ & int(I.MASK), key_ >> I.BITS & int(I.MASK)) == (back[n], t[i])
        near = key_ >> 2 * I.BITS
        assert near == back[0] if n == 1 else near >= 1 << I.BITS
        assert known.setdefault(tuple(back[:n]), near) == near
    assert len(set(known.values())) == len(known)
    assert (I.keys_of(units, first, 9) >> np.uint64(2 * I.BITS)).max() == 9


@pytest.mark.parametrize(("frequent", "hot"), [(8, 1 << 22), (1 << 17, 1 << 22), (1 << 17, 100)])
def test_score_is_the_product_of_both_factors(spark, monkeypatch, frequent, hot):
    """The whole way over blocks and parts, rest words in buckets and empty texts included, against one call with all tokens."""
    monkeypatch.setattr(M, "FREQUENT", frequent)
    monkeypatch.setattr(I, "HOT", hot)
    rng = random.Random(7)
    texts = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 300)}" for _ in range(rng.randrange(0, 50)))) for i in range(150)]
    texts += [(900, None), (901, ""), (902, "never seen ones"), texts[3]]
    held = lambda i: i % 5 == 1
    docs = documents(spark, texts)
    model, counts = M.train(docs, "text", "doc_id", F.col("doc_id") % 5 != 1)
    c = {r.word: r.c for r in counts.collect()}
    kinds, whole = M.unit_classes(model)
    keys, row, logs = [], [], []
    for i, (_, text) in enumerate(texts):
        tokens, first = M.tokens_of(M.pa.array([text], M.pa.string()))
        place = M.places(model, tokens)
        right = M.classes_of(model, tokens, place)
        units = M.units_of(model, tokens, place)
        assert (kinds[units] == right).all()
        share = M.log_shares(model, M.features(tokens, first), 0, len(tokens))[np.arange(len(tokens)), right]
        in_class = [math.log((c.get(int(t), 0) + 0.5) / whole[k]) for t, k in zip(tokens.view(np.int64), right, strict=True)]
        logs.append(share.sum() + sum(in_class))
        keys.append(I.keys_of(units, first, len(model.masses), model.hot))
        row += [i] * len(tokens)
    trained = np.array([not held(texts[i][0]) for i in row])
    gain = np.bincount(row, I.gains(np.concatenate(keys), trained, model.masses, kinds, whole), len(texts))
    got = sorted((r.doc_id, r.score) for r in M.score(docs, F.col("doc_id") % 5 == 1).collect())
    want = sorted((i, (a + b) / math.log(10)) for (i, _), a, b in zip(texts, logs, gain, strict=True))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-4, abs=1e-4)
    assert abs(gain).sum() > 1 and (model.hot > 0) == (hot < 1 << 22)
    # every bucket has the mass of its words and of one unknown word
    n = len(model.words)
    assert model.masses[n:].sum() == pytest.approx(sum(v + 0.5 for w, v in c.items() if np.int64(w).view(np.uint64) not in model.words) + 0.5 * (len(model.masses) - n))
