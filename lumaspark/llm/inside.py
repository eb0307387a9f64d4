"""Words inside their class: the second factor of the model of ``maxent``.

A unit is a frequent word, or a bucket of the other words of a class by hash. Given its class and context, a unit has the probability

    mass(unit) * exp(pair[word before, unit] + triple[two words before, unit]) / Z(class, context)

where a bucket's mass is that of its words and of one unknown word. Weights belong to the n-grams met in training, so the model grows with the corpus, and units without a weight enter Z by
their mass alone, so Z is exact without a walk over the class. Weights have an exponential prior (none is below 0, and an n-gram's count is lessened by a discount, estimated from the n-grams
that occur once and twice beside it); they are fitted by proportional updates of pairs and triples in turn, each over all training tokens, until a round no longer raises the likelihood.

All weights that the tokens of one class after one word need are theirs alone. So tokens are shuffled by that group, in blocks, and each group is fitted and scored where it lies; what goes back
is one sum per block and text. A task holds its groups. So that none grows with the corpus, a word before that has more than ``HOT`` training tokens is taken together with the word before it,
and so on up to ``MOST_NEAR`` words, as one word before, known by a hash; the word before all these is then the second one. Only what follows that many such words, or the beginning of a text,
makes a group that is not bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import words as W

BITS, NEAR_BITS = 20, 24  # of a unit, and of the word or words before
MASK = np.uint64((1 << BITS) - 1)
PLANES = 13  # bytes of a token: three units and its mark
TOKENS_A_TASK = 1 << 20
TOKENS_A_BLOCK = 1 << 20
AT_ONCE = 1 << 17  # triples
LEAST_PARTS = 8
HOT, MOST_NEAR = 1 << 22, 8
SETTLED = 1e-3  # rise of the likelihood per training token below which a group has settled
ONCE, MET = 3.0, 4.0  # n-grams that occur once, and of all, that a group's discount starts from


def before(units: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """The unit before each, ``begin`` at the start of a text."""
    out = np.empty_like(units)
    out[1:] = units[:-1]
    out[first[:-1]] = begin
    return out


def keys_of(units: np.ndarray, first: np.ndarray, begin: int, hot: int = 0) -> np.ndarray:
    """Word before, unit and second word before as one number. Units below ``hot`` are taken together with what is before them."""
    near = before(units, first, begin)
    second = before(near, first, begin)
    far, longer = near, near < hot
    near = near.copy()
    for _ in range(MOST_NEAR - 1):
        if not longer.any():
            break
        # words taken together have numbers past those of the units
        joined = W.mix(near[longer].astype(np.uint64) << np.uint64(32) | second[longer].astype(np.uint64)) % np.uint64((1 << NEAR_BITS) - (1 << BITS))
        near[longer] = joined.astype(near.dtype) + (1 << BITS)
        far = before(far, first, begin)
        second = np.where(longer, before(far, first, begin), second)
        longer &= far < hot
    return (near.astype(np.uint64) << np.uint64(2 * BITS)) | (units.astype(np.uint64) << np.uint64(BITS)) | second.astype(np.uint64)


def packed(keys: np.ndarray, marks: np.ndarray, part: np.ndarray):
    """Tokens of a block → part, number and bytes of each part's tokens. ``marks`` rise within a block but for their last bit."""
    order = np.argsort(part, kind="stable")
    keys, marks, part = keys[order], marks[order], part[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    step = np.diff(marks, prepend=np.uint32(0))
    step[cut] = marks[cut]
    planes = np.empty((PLANES, len(keys)), np.uint8)
    for k, shift in enumerate((2 * BITS, BITS, 0)):
        unit = keys >> np.uint64(shift) if not k else (keys >> np.uint64(shift)) & MASK
        for j in range(3):
            planes[3 * k + j] = unit >> np.uint64(8 * j)
    for j in range(4):
        planes[9 + j] = step >> np.uint32(8 * j)
    codec = pa.Codec("zstd", 1)
    for a, b in zip(cut, np.append(cut[1:], len(keys)), strict=True):
        yield int(part[a]), int(b - a), codec.compress(planes[:, a:b].tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and marks."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, PLANES * n, asbytes=True), np.uint8).reshape(PLANES, n)
    keys, step = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    for k, shift in enumerate((2 * BITS, BITS, 0)):
        for j in range(3):
            keys |= planes[3 * k + j].astype(np.uint64) << np.uint64(shift + 8 * j)
    for j in range(4):
        step |= planes[9 + j].astype(np.uint32) << np.uint32(8 * j)
    return keys, np.cumsum(step, dtype=np.uint32)


def numbered(sorted_keys: np.ndarray) -> np.ndarray:
    """The number of each run of equal keys."""
    change = np.zeros(len(sorted_keys), np.int64)
    change[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.cumsum(change)


def renumbered(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the numbers below ``n`` that occur, and each one's place among them."""
    used = np.zeros(n, bool)
    used[ids] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[ids]


def lessened(n: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Counts less their group's discount."""
    once, twice = np.bincount(group, n == 1, groups), np.bincount(group, n == 2, groups)
    return np.maximum(n - ((once + ONCE) / (once + 2 * twice + MET))[group], 0)


def started(n: np.ndarray, mass: np.ndarray, of: np.ndarray, whole: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Exponentials of weights that alone would give each n-gram its count ``n`` of its context's ``total``; ``whole`` is the mass of a context."""
    left = np.maximum(whole - np.bincount(of, mass, len(whole)), 0)
    z = left * total / np.maximum(total - np.bincount(of, n, len(whole)), 1e-9)
    return np.maximum(n / np.maximum(total, 1e-9)[of] * z[of] / mass, 1.0)


def fitted(n: np.ndarray, pair: np.ndarray, context: np.ndarray, pair_group: np.ndarray, context_group: np.ndarray, mass: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the weights of pairs and triples: ``n`` per triple (all above 0), its pair and context, their groups, ``mass`` per pair, ``whole`` per group."""
    a1, a2 = lessened(np.bincount(pair, n, len(mass)), pair_group, len(whole)), lessened(n, pair_group[pair], len(whole))
    met, total = np.bincount(context, n, len(context_group)), np.bincount(context_group, np.bincount(context, n, len(context_group)), len(whole))
    x1 = started(a1, mass, pair_group, whole, total)
    base = whole + np.bincount(pair_group, mass * (x1 - 1), len(whole))
    x2 = started(a2, (mass * x1)[pair], context, base[context_group], met)
    out1, out2 = x1.copy(), x2.copy()
    of_pair, of_triple = np.arange(len(x1)), np.arange(len(x2))
    reached = np.full(len(whole), -np.inf)
    while len(n):
        for step in range(2):
            weight = (mass * x1)[pair]
            z = (whole + np.bincount(pair_group, mass * (x1 - 1), len(whole)))[context_group] + np.bincount(context, weight * (x2 - 1), len(met))
            rate = met / z
            if not step:
                value = np.bincount(pair_group, a1 * np.log(x1), len(whole)) + np.bincount(pair_group[pair], a2 * np.log(x2), len(whole)) - np.bincount(context_group, met * np.log(z), len(whole))
                live = value - reached > SETTLED * total
                reached = value
                expected = mass * x1 * (np.bincount(context_group, rate, len(whole))[pair_group] + np.bincount(pair, rate[context] * (x2 - 1), len(x1)))
                x1 = np.where(live[pair_group], np.maximum(x1 * a1 / expected, 1), x1)
            else:
                x2 = np.where(live[pair_group[pair]], np.maximum(x2 * a2 / (weight * x2 * rate[context]), 1), x2)
        out1[of_pair], out2[of_triple] = x1, x2
        # groups that have settled leave
        if not live.all():
            p, c, t = live[pair_group], live[context_group], live[pair_group[pair]]
            g, new_pair, new_context = np.cumsum(live) - 1, np.cumsum(p) - 1, np.cumsum(c) - 1
            n, pair, context, x2, a2, of_triple = n[t], new_pair[pair[t]], new_context[context[t]], x2[t], a2[t], of_triple[t]
            pair_group, mass, x1, a1, of_pair = g[pair_group[p]], mass[p], x1[p], a1[p], of_pair[p]
            context_group, met, whole, total, reached = g[context_group[c]], met[c], whole[live], total[live], reached[live]
    return out1, out2


def gains(keys: np.ndarray, trained: np.ndarray, masses: np.ndarray, classes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log of what its context makes of each token's probability inside its class. Whole groups are given; ``masses`` and ``classes`` are per unit, ``whole`` is the mass per class."""
    triples, at = np.unique(keys, return_inverse=True)
    at = at.astype(np.int32)
    n = np.bincount(at, trained, len(triples))
    out = np.empty(len(triples))
    # a few groups at once: those of the same words before lie together
    near = triples >> np.uint64(2 * BITS)
    cut = np.append(np.flatnonzero(near[1:] != near[:-1]) + 1, len(triples))
    low = 0
    while low < len(triples):
        high = int(cut[min(np.searchsorted(cut, low + AT_ONCE), len(cut) - 1)])
        out[low:high] = triple_gains(triples[low:high], n[low:high], masses, classes, whole)
        low = high
    return out[at]


def triple_gains(triples: np.ndarray, n: np.ndarray, masses: np.ndarray, classes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``gains`` of sorted triples, which occur ``n`` times in training."""
    pair = numbered(triples >> np.uint64(BITS))
    pairs = triples[np.flatnonzero(np.diff(pair, prepend=-1))] >> np.uint64(BITS)
    unit = (pairs & MASK).astype(np.int64)
    kind = classes[unit]
    pair_key = ((pairs >> np.uint64(BITS)) << np.uint64(5)) | kind.astype(np.uint64)
    contexts, context = np.unique((pair_key[pair] << np.uint64(BITS)) | (triples & MASK), return_inverse=True)
    context_group = numbered(contexts >> np.uint64(BITS))
    groups = contexts[np.flatnonzero(np.diff(context_group, prepend=-1))] >> np.uint64(BITS)
    pair_group = np.searchsorted(groups, pair_key)
    mass, all_mass = masses[unit], whole[(groups & np.uint64(31)).astype(np.int64)]
    # only n-grams of training texts have weights
    t = np.flatnonzero(n)
    used_pairs, used_pair = renumbered(pair[t], len(pairs))
    used_contexts, used_context = renumbered(context[t], len(contexts))
    used_groups, used_pair_group = renumbered(pair_group[used_pairs], len(groups))
    _, used_context_group = renumbered(context_group[used_contexts], len(groups))
    x1, x2 = np.ones(len(pairs)), np.ones(len(triples))
    x1[used_pairs], x2[t] = fitted(n[t], used_pair, used_context, used_pair_group, used_context_group, mass[used_pairs], all_mass[used_groups])
    z = (all_mass + np.bincount(pair_group, mass * (x1 - 1), len(groups)))[context_group] + np.bincount(context, (mass * x1)[pair] * (x2 - 1), len(contexts))
    return np.log(x1)[pair] + np.log(x2) - np.log(z / all_mass[context_group])[context]


def parts_of(keys: np.ndarray, kind: np.ndarray, parts: int) -> np.ndarray:
    """The part of each token by the word before it and its class."""
    group = ((keys >> np.uint64(2 * BITS)) << np.uint64(5)) | kind.astype(np.uint64)
    return (W.mix(group) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
