"""Rules of URLs with many frequent tokens, against brute force over all sets of tokens."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations
from math import log

from lodestone.llm import url_filter

ROWS = "tokens array<string>, block boolean"


def brute(rows, least, confidence, chance):
    """Rules by growing all sets of tokens level by level."""
    have = defaultdict(set)
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            have[t].add(i)
    bad, n = {i for i, (_, b) in enumerate(rows) if b}, len(rows)
    firsts = {}
    for t in sorted(have):
        if least <= len(have[t]) < n:
            firsts.setdefault(frozenset(have[t]), t)
    sets = now = {frozenset([t]): r for r, t in firsts.items()}
    while now:
        grown = {}
        for s, r in now.items():
            for r2, t in firsts.items():
                if t not in s and len(both := r & r2) >= least and all(len(now.get((s | {t}) - {x}, ())) > len(both) for x in s | {t}):
                    grown[s | {t}] = both
        sets, now = {**sets, **grown}, grown
    share, rules = len(bad) / n, {}
    for s, r in sets.items():
        b = len(r & bad)
        c = b / len(r)
        if b >= least and c >= confidence and c > share:
            apart = c * log(c / share) + ((1 - c) * log((1 - c) / (1 - share)) if c < 1 else 0)
            if len(r) * apart >= log(len(sets) / chance):
                rules[s] = (round(c, 9), round(b / n, 9))
    return {s: v for s, v in rules.items() if not any(frozenset(p) in rules for k in range(1, len(s)) for p in combinations(s, k))}


def mined(frame, *args):
    got = url_filter.mine(frame, *args).collect()
    rules = {frozenset(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in got}
    assert len(got) == len(rules)
    return rules


def made(seed, n=300, tokens=11):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        have = [f"t{i:02}" for i in range(tokens) if rng.random() < 0.15 + 0.06 * i]
        have += [f"c{i}" for i in range(rng.randrange(6))] + ["all"]
        have += ["twin"] * ("t03" in have)
        bad = {"t01", "t09"} <= set(have) or {"t05", "t07", "t10"} <= set(have) or "c4" in have
        rows.append((have, bad if rng.random() < 0.97 else not bad))
    return rows


def test_width_never_decides_the_result(spark, monkeypatch):
    rows = made(5)
    want = brute(rows, 10, 0.85, 0.01)
    assert {len(s) for s in want} >= {1, 2, 3}
    frame = spark.createDataFrame(rows, ROWS)
    for widest, together in ((16, 50_000), (5, 100)):
        monkeypatch.setattr(url_filter, "WIDEST", widest)
        monkeypatch.setattr(url_filter, "TOGETHER", together)
        assert mined(frame, 0.001, 0.85) == want


def test_frequent_tokens_of_wide_urls_make_rules(spark):
    """Most URLs have over 16 tokens that are rarer than the two that block together."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        have = [t for t, p in (("path:bets", 0.7), ("key:ref", 0.75)) if rng.random() < p]
        # nested paths: a longer one has all tokens of the shorter
        have += [f"part{i % 2}:{k:02}" for k in range(24) if rng.random() < 0.05 or k <= 3 + 20 * (i % 40 < 30)]
        rows.append((have, len(set(have) & {"path:bets", "key:ref"}) == 2))
    assert max(len(r[0]) for r in rows) > url_filter.WIDEST
    assert mined(spark.createDataFrame(rows, ROWS), 0.001, 0.9) == {frozenset(["path:bets", "key:ref"]): (1.0, sum(b for _, b in rows) / 400)}
