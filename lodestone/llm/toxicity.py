"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, bigrams and skip-grams of a text. A feature's value is the log of
the inverse share of rows that have it, so that rare marks outweigh common words; one in fewer than RARE
rows of the sample has no weight. FTRL gives every coordinate its own learning rate, and its L1 term leaves most weights exactly
zero, so the model is a short list of (feature, weight) pairs that is broadcast whatever the corpus.

It is fitted on a bounded sample of labelled rows (see ``_sample``): up to SAMPLE / 2 of either label and
SAMPLE_BYTES of features. A label that is cut gets a weight that restores its share. The bias is then moved
to where scores of rows that were left out of a fit (in three turns) separate best by F1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import claim, texts
from lodestone.llm._features import grams
from lodestone.llm._sample import fit_one, pick

BITS = 20
#: Labelled rows, and bytes of their features, that the fit uses at most; the only bounds on what it sees.
SAMPLE, SAMPLE_BYTES = 16_000, 256_000_000
#: Rows of the sample that a feature must have.
RARE = 3
#: Toxic rows weigh more: they are few, and to miss one costs more.
POSITIVE = 2.0
# chosen by cross-validation within the training folds
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 20.0, 0.1, 2


def fold(id_col: str = "doc_id"):
    """crc32 of the key as text, modulo 5; null counts as the empty string, which is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def values_of(rows: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Value of every feature, by its share of the rows; the last is the bias."""
    df = np.zeros((1 << bits) + 1, np.int64)
    for r in rows:
        df[r] += 1
    out = np.where(df >= RARE, np.log((len(rows) + 1) / (df + 1)), 0.0)
    out[-1] = 1
    return out


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = BITS) -> tuple[dict[int, float], float]:
    """FTRL-proximal over rows of distinct feature ids -> ({feature: non-zero weight x value}, bias)."""
    n = np.zeros((1 << bits) + 1)
    z = np.zeros((1 << bits) + 1)
    bias = 1 << bits
    l1 = np.full((1 << bits) + 1, L1)
    l1[bias] = 0
    value = values_of(rows, bits)

    def current(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= l1[f], 0.0, -(zf - np.sign(zf) * l1[f]) / ((BETA + np.sqrt(n[f])) / ALPHA + L2))

    held = [np.append(r[value[r] > 0], np.int32(bias)) for r in rows]
    order = np.arange(len(rows))
    for turn in range(PASSES):
        np.random.default_rng(turn).shuffle(order)
        for i in order.tolist():
            f = held[i]
            w, v = current(f), value[f]
            p = 1 / (1 + math.exp(-min(35.0, max(-35.0, float(w @ v)))))
            g = (p - labels[i]) * weights[i] * v
            was = n[f]
            n[f] = was + g * g
            z[f] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / ALPHA * w
    every = current(np.arange(len(z))) * value
    some = np.flatnonzero(every[:-1])
    return dict(zip(some.tolist(), every[some].tolist(), strict=True)), float(every[bias])


def shift_of(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """What to add to scores so that those over 0 are the toxic ones as well as may be, by F1.

    The cut lies midway between two scores. Without both labels it stays at 0.
    """
    if not (labels == 1).any() or not (labels == 0).any():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], (weights * labels)[order]
    caught, taken = np.cumsum(hit), np.cumsum(weights[order])
    f1 = 2 * caught / (taken + hit.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no cut between equal scores
    at = int(f1.argmax())
    return -float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else -float(s[at])


def fit_calibrated(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = BITS) -> tuple[dict[int, float], float]:
    """``fit_ftrl`` with the bias moved by what left-out thirds show."""
    pulled = weights * np.where(labels == 1, POSITIVE, 1.0)
    third, scores = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for t in range(3):
        mine = np.flatnonzero(third != t)
        if not len(mine):
            continue
        model, bias = fit_ftrl([rows[i] for i in mine], labels[mine], pulled[mine], bits)
        dense = np.zeros(1 << bits)
        dense[list(model)] = list(model.values())
        for i in np.flatnonzero(third == t):
            scores[i] = bias + dense[rows[i]].sum()
    model, bias = fit_ftrl(rows, labels, pulled, bits)
    return model, bias + shift_of(scores, labels, weights)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[dict[int, float], float]:
    """Fit on labelled rows outside the held-out fold. No labelled row gives no weight and bias 0.

    Null labels and keys and labels of unknown rows are left out. A key counts once for each label it has,
    however often it or its label repeats, with the text whose features are smallest.
    """
    half = sample // 2
    picked, counts = pick(labels.where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0)), F.col(label_col), id_col, lambda _: half)
    if picked is None:
        return {}, 0.0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("features")
        for batch in batches:
            made = [np.unique(grams(t, BITS)).astype(np.int32) for t in texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([m.tobytes() for m in made], pa.binary())], names=["k", "y", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            rows += [np.frombuffer(f, np.int32) for f in b.column("f").to_pylist()]
            y += b.column("y").to_pylist()
        if rows:
            marks = np.array(y)
            weights = np.where(marks == 1, max(1.0, counts.get(1, 0) / half), max(1.0, counts.get(0, 0) / half))
            model, bias = fit_calibrated(rows, marks, weights / weights.mean())
            ids, values = np.fromiter(model, np.int32, len(model)), np.fromiter(model.values(), np.float64, len(model))
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([values.tobytes()]), pa.array([bias])], names=["ids", "weights", "bias"])

    got = fit_one(docs, picked, id_col, text_col, features, "f", sample_bytes, fit, "ids binary, weights binary, bias double")
    if not got:
        return {}, 0.0
    return dict(zip(np.frombuffer(got[0].ids, np.int32).tolist(), np.frombuffer(got[0].weights, np.float64).tolist(), strict=True)), got[0].bias


def score(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's probability: key, held_out, score, predicted.

    Cases: null and empty texts have no feature and score the bias; texts of any length count whole;
    repeated rows stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = pa.schema([("k", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("features")
        weights, bias = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[list(weights)] = list(weights.values())
        for batch in batches:
            out = []
            for t in texts(batch.column("t")):
                f = grams(t, BITS)
                f = np.unique(f[dense[f] != 0])
                x = bias + float(dense[f].sum(dtype=np.float64))
                out.append(1 / (1 + math.exp(-min(35.0, max(-35.0, x)))))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("held_out"), pa.array(out, pa.float64())], schema=fields)

    rows = docs.select(F.col(id_col).cast("long").alias("k"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    scored = rows.mapInArrow(run, "k long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("k", id_col)
