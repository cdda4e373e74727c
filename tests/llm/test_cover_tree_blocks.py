"""Top-k over blocks: bounds of any sign, pivots, hot cells, lengths of vectors, and what is not scored."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import cover_tree

FIELDS = "vec_id long, embedding array<double>"


def brute(ids, x, queries, k):
    out = {}
    for a in queries:
        s = [(-int(np.dot(x[a], x[b])), ids[b]) for b in range(len(ids)) if b != a and len(x[a]) == len(x[b])]
        out.setdefault(ids[a], []).append([(r + 1, i, -v) for r, (v, i) in enumerate(sorted(s)[:k])])
    return {i: sorted(v) for i, v in out.items()}


def test_large_negative_scores_keep_their_ties():
    """Duplicated points whose scores are near -3e9: a bound must be widened upwards."""
    rng = np.random.default_rng(4)
    wrong = 0
    for _ in range(20):
        base = rng.integers(-7000, 7000, (60, 64)).astype(float)
        points = np.concatenate([base, base, base - 1])
        queries = -points[rng.integers(0, len(points), 40)]
        ids = rng.permutation(len(points))
        scores, rows = cover_tree.search(queries, np.arange(40), points, ids, 5)
        for q, s, r in zip(queries, scores, rows, strict=True):
            want = sorted((-int(v), int(i)) for v, i in zip(points @ q, ids, strict=True))[:5]
            wrong += [(-int(a), int(ids[b])) for a, b in zip(s, r, strict=True)] != want
    assert wrong == 0
    assert cover_tree._over(-3e9) > -3e9 and cover_tree._over(3e9) > 3e9


@pytest.mark.parametrize("kind", ["clusters", "noise", "hot", "negative"])
def test_blocks_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(cover_tree, "CANDIDATES", 50)
    monkeypatch.setattr(cover_tree, "QUERIES", 16)
    monkeypatch.setattr(cover_tree, "PIVOTS", 12)
    rng = np.random.default_rng(7)
    n = 600
    x = rng.normal(size=(n, 6))
    if kind == "clusters":
        x = rng.normal(size=(9, 6))[rng.integers(0, 9, n)] * 5 + x * 0.05
    elif kind == "hot":
        x[: n // 2] = x[0]
    elif kind == "negative":
        x = np.abs(x) * np.where(np.arange(n) % 5 == 0, -1, 1)[:, None] * 3
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows[30] = (30, rows[30][1][:4])
    rows[35], rows[36] = (35, [1.0]), (36, [2.0])
    rows += [rows[5], rows[5], (None, rows[5][1]), (700, None), (705, [None] * 6), (710, [float("nan")] * 6), (715, [])]
    kept = [(i, np.floor(np.array(v) * 256)) for i, v in rows if i is not None and v is not None and None not in v and all(np.isfinite(v))]
    ids, x = [i for i, _ in kept], [v for _, v in kept]
    want = brute(ids, x, [a for a in range(len(ids)) if ids[a] % 5 == 0], 5)
    got: dict = {}
    for r in cover_tree.top_k(spark.createDataFrame(rows, FIELDS), lambda i: i % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # copies of a query give the same rows
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(r for one in v for r in one) for i, v in want.items() if any(v)}


def test_blocks_are_pruned_before_rows_are_copied(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CANDIDATES", 100)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(10, 8)) * 4)[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 8)) * 0.01
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], FIELDS)
    assert cover_tree.scored_share(rows, lambda i: i % 20 == 0) < 0.3
