"""Decontamination of texts that repeat shingles and of texts shorter than an item, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from lodestone.llm import decontaminate


def grams(words, n=5):
    n = min(n, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def brute(text, items, least=0.8):
    """Item position -> similarity of the best window; a text shorter than an item is one window."""
    w, out = decontaminate.words_of(text), {}
    for k, (_, v) in enumerate(items):
        a, width = Counter(grams(v)), min(len(v), len(w))
        for s in range(len(w) - width + 1):
            b = Counter(grams(w[s : s + width]))
            both = (a & b).total()
            if both and (found := both / ((a.total() + b.total()) - both)) >= least:
                out[k] = max(out.get(k, 0.0), found)
    return out


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_sums_tell_equal_shingles_apart():
    rng = np.random.default_rng(4)
    shingles = rng.integers(0, 6, 90).astype(np.uint64)
    for width in (1, 2, 17, 90):
        got = decontaminate._sums(shingles, width)
        for at in range(len(shingles) - width + 1):
            part, seen, want = shingles[at : at + width], Counter(), 0
            for s in part.tolist():
                want = want + decontaminate._planes(decontaminate._nth(np.array([s], np.uint64), np.array([seen[s]])))[0].astype(int)
                seen[s] += 1
            assert (got[at] == want).all()


def test_repeated_shingles_and_short_texts():
    rng = random.Random(8)
    items = [words(rng, n) for n in (60, 100, 200, 200)]
    # an item that repeats words itself
    items.append([*words(rng, 30), *["so"] * 24, *words(rng, 30)])
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)], 5)
    base, many = items[2], items[4]
    made = [
        # one shingle often in place of the item's end
        [*words(rng, 9), *base[:180], *["la"] * 20, *words(rng, 9)],
        [*base[:180], *["la"] * 20],
        [*["la"] * 40, *base[20:], *["la"] * 40],
        many,
        [*many[:30], *["so"] * 20, *many[54:]],
        [*words(rng, 5), *many[:30], *["so"] * 28, *many[54:]],
        ["so"] * 3000,
        # shorter than the item: alike enough, at the edge, and not
        *(base[:n] for n in (199, 190, 161, 160, 159, 150)),
        *(items[0][a:] for a in (1, 5, 11, 12, 13)),
        many[:-6],
        items[0][:4],
    ]
    found = 0
    for w in made:
        text = " ".join(w)
        got = index.matches(text, 0.8)
        want = brute(text, index.items)
        assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
        found += len(want)
    assert found > 12
