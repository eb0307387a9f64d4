"""Language codes against a plain loop over texts, trigrams and bits."""

import math
import random

import pytest

from lumaspark.llm import ecoc_language as L
from text_tables import documents


def features(text):
    data, out = text.lower().encode(), []
    letter = [65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in data]
    for i in range(len(data) - 2):
        if sum(letter[i : i + 3]) >= 2:
            a, b, c = (v if is_letter else 32 for v, is_letter in zip(data[i : i + 3], letter[i : i + 3], strict=True))
            out.append(((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 18)
    return out


def learned(rows):
    """Languages, and per bit its codeword column, the log ratio of each feature and the trust."""
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            of = counts.setdefault(lang, {})
            for f in features(text):
                of[f] = of.get(f, 0) + 1
    languages = sorted(counts)
    code = L.codewords(len(languages))
    bits = []
    for j in range(code.shape[1]):
        on, off = [L.SMOOTHING] * L.FEATURES, [L.SMOOTHING] * L.FEATURES
        for i, lang in enumerate(languages):
            for f, n in counts[lang].items():
                (on if code[i][j] > 0 else off)[f] += n
        all_on, all_off = sum(on), sum(off)
        ratio = [math.log(a / all_on * all_off / b) for a, b in zip(on, off, strict=True)]
        bits.append((ratio, sum((a / all_on - b / all_off) * r for a, b, r in zip(on, off, ratio, strict=True))))
    return languages, code, bits


def decoded(model, text):
    languages, code, bits = model
    found = features(text)
    trust = sum(t for _, t in bits)
    loss = [0.0] * len(languages)
    for j, (ratio, t) in enumerate(bits):
        z = sum(ratio[f] for f in found) / math.sqrt(max(len(found), 1))
        for i in range(len(languages)):
            loss[i] += len(bits) * t / trust * math.log1p(math.exp(-z * code[i][j]))
    like = [math.exp(min(loss) - x) for x in loss]
    ranked = sorted(range(len(languages)), key=lambda i: (-like[i], i))
    first, second = (like[i] / sum(like) for i in ranked[:2])
    return languages[ranked[0]], first, languages[ranked[1]], first - second < L.AMBIGUOUS


@pytest.mark.parametrize("n", [2, 4, 7])
def test_bits_and_decoding_equal_a_plain_loop(spark, n):
    """Two languages, four (the exhaustive code) and seven (a random one)."""
    rng = random.Random(n)
    stems = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 6))) for _ in range(40)] for _ in range(n)]
    rows = []
    for i in range(12 * n):
        own, other = stems[i % n], stems[rng.randrange(n)]
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.7 else other) for _ in range(rng.randrange(1, 40))).capitalize() + " 123, x2", f"l{i % n}"))
    rows += [(900, None, "l0"), (901, "unlabelled text", None), (902, "", "l1"), (3, rows[3][1], "l0")]
    docs = documents(spark, [(*r, None) for r in rows])
    got = {(r.doc_id, r.text): r for r in L.identify(docs, L.train(docs)).collect()}
    model = learned(rows)
    for doc_id, text, _ in rows:
        r = got[doc_id, text]
        if not text:
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
            continue
        lang, score, second, ambiguous = decoded(model, text)
        assert r.score == pytest.approx(score, rel=1e-9)
        if score - 1e-9 > 1 / n:
            assert (r.lang_pred, r.runner_up, r.ambiguous) == (lang, second, ambiguous)
