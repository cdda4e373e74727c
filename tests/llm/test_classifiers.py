"""The classifiers against naive versions of what they fit, and the bounds of their samples."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality, toxicity

BITS = 6


def naive_ftrl(rows, labels, weights):
    """FTRL-proximal in dicts, one coordinate at a time."""
    bias, n, z, w = 1 << BITS, {}, {}, {}
    df = {f: sum(f in r for r in rows) for r in rows for f in r}
    value = {f: math.log((len(rows) + 1) / (c + 1)) for f, c in df.items() if c >= toxicity.RARE} | {bias: 1.0}

    def weight(f):
        zf, l1 = z.get(f, 0.0), 0.0 if f == bias else toxicity.L1
        return 0.0 if abs(zf) <= l1 else -(zf - math.copysign(l1, zf)) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    order = np.arange(len(rows))
    for turn in range(toxicity.PASSES):
        np.random.default_rng(turn).shuffle(order)
        for i in order.tolist():
            fs = [f for f in [*rows[i].tolist(), bias] if value.get(f, 0) > 0]
            w = {f: weight(f) for f in fs}
            x = sum(w[f] * value[f] for f in fs)
            p = 1 / (1 + math.exp(-x))
            for f in fs:
                g = (p - labels[i]) * weights[i] * value[f]
                was = n.get(f, 0.0)
                n[f] = was + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(was)) / toxicity.ALPHA * w[f]
    return {f: weight(f) * value[f] for f in value if f != bias and weight(f)}, weight(bias)


def test_ftrl_equals_a_naive_one(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 2.0)
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 300)
    rows = [np.unique(np.append(rng.integers(0, 50, 8), 60 if y and rng.random() < 0.7 else 61)).astype(np.int32) for y in labels]
    weights = rng.random(300) + 0.5
    got, bias = toxicity.fit_ftrl(rows, labels, weights, BITS)
    want, want_bias = naive_ftrl(rows, labels, weights)
    assert set(got) == set(want) and got[60] > 0
    assert all(abs(got[f] - want[f]) < 1e-9 for f in want) and abs(bias - want_bias) < 1e-9


def test_shift_is_the_best_cut():
    rng = random.Random(2)
    for _ in range(50):
        s = np.array([round(rng.gauss(0, 1), 1) for _ in range(30)])
        y = np.array([int(rng.random() < 1 / (1 + math.exp(-2 * x))) for x in s])
        if not 0 < y.sum() < 30:
            continue
        w = np.array([rng.random() + 0.1 for _ in s])
        f1 = lambda t: 2 * w[(s > t) & (y == 1)].sum() / (w[s > t].sum() + w[y == 1].sum())  # noqa: B023, E731
        best = max(f1(t) for t in [-9, *s])
        assert abs(f1(-toxicity.shift_of(s, y, w) if len(set(s)) > 1 else 0) - best) < 1e-9 or abs(f1(-toxicity.shift_of(s, y, w) - 1e-6) - best) < 1e-9
    assert toxicity.shift_of(np.zeros(3), np.ones(3), np.ones(3)) == 0


def naive_loss(w, t, rows, level, sw):
    total = 0.0
    for (ids, values), g, s in zip(rows, level, sw, strict=True):
        x = sum(w[i] * v for i, v in zip(ids, values, strict=True))
        tails = [1.0, *(1 / (1 + math.exp(-(x - c))) for c in t), 0.0]
        total -= s * math.log(tails[g] - tails[g + 1])
    return total / sum(sw) + quality.RIDGE / 2 * float(np.square(w).sum())


def test_ordinal_fit_is_a_minimum_of_the_naive_loss(monkeypatch):
    monkeypatch.setattr(quality, "RIDGE", 1e-2)
    rng = np.random.default_rng(1)
    rows = [(np.array([2, 5, 9]), rng.normal(size=3).astype(np.float32)) for _ in range(200)]
    level = np.array([int(np.digitize(2 * v[0] - v[1] + rng.logistic(), [-1, 1])) for _, v in rows])
    sw = rng.random(200) + 0.5
    m = quality.Ordinal.fit(rows, level * 10, sw, [0, 10, 20])
    base = naive_loss(m.weights.astype(float), m.thresholds, rows, level, sw)
    for i in (2, 5, 9):
        for d in (-0.05, 0.05):
            w = m.weights.astype(float)
            w[i] += d
            assert naive_loss(w, m.thresholds, rows, level, sw) > base - 1e-6
    for j in range(2):
        for d in (-0.05, 0.05):
            t = m.thresholds.copy()
            t[j] += d
            assert naive_loss(m.weights.astype(float), t, rows, level, sw) > base - 1e-6


DOCS = "doc_id long, text string"


def test_one_key_does_not_fill_the_sample(spark, monkeypatch):
    """50,000 rows and labels of one key count once, and what a fit is given stays within its bounds."""
    rng = random.Random(8)
    plain = [(i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(9)) + (" vile" if i % 3 == 0 else "")) for i in range(1, 200)]
    docs, labels = spark.createDataFrame(plain, DOCS), spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i, _ in plain], "doc_id long, toxic int, quality int")
    many = docs.unionByName(spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(plain[0][1]).alias("text")))
    again = labels.unionByName(spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("toxic"), F.lit(1).alias("quality")))
    assert toxicity.train(many, again) == toxicity.train(docs, labels)
    a, b = quality.train(many, again), quality.train(docs, labels)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_bytes_of_a_sample_are_bounded(spark):
    docs = spark.range(1, 60).select(F.col("id").alias("doc_id"), F.expr("repeat(concat(id, ' vile ', id * 7, ' word '), 3000)").alias("text"))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic", "CAST(doc_id % 2 AS INT) AS quality")
    few = toxicity.train(docs, labels, sample_bytes=0)
    assert few == ({}, 0.0)
    assert quality.train(docs, labels, sample_bytes=0).grades == [0, 1]
    assert quality.train(docs, labels, sample_bytes=300).weights.any() and toxicity.train(docs, labels, sample_bytes=400) != ({}, 0.0)
    null = labels.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "toxic", "quality")
    assert toxicity.train(docs, null) == ({}, 0.0) and quality.train(docs, null).grades == []
