"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade > g_j | text) = logistic(w . x - t_j): one weight vector shared by all thresholds t_1 < t_2 < ...
x holds hashed words, hashed word shapes (runs of upper case, lower case, digits and the marks
themselves), each as its share of the text's words, and the share of words that repeat the one before.
The fit gives an expected grade and, for selection, the tail probability of the upper grades.

It is fitted on a bounded sample (see ``_sample``): up to SAMPLE / grades rows of each grade and
SAMPLE_BYTES of features, weighted to their true shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import claim, remembers, texts
from lodestone.llm._features import LONGEST, REMEMBERED
from lodestone.llm._sample import fit_one, pick

BITS = 15
#: Labelled rows, and bytes of their features, that the fit uses at most; the only bounds on what it sees.
SAMPLE, SAMPLE_BYTES = 12_000, 64_000_000
#: Full-batch steps of Adam, its rate, and the ridge on weights.
STEPS, RATE, RIDGE = 300, 0.05, 1e-4
#: Shares of shapes and repeats are scaled up against those of words, which are many and rare.
SHAPE, REPEAT = 4.0, 8.0
_LETTERS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """Runs as one sign each: ``A`` upper case, ``a`` other letters, ``9`` digits; marks stay."""
    if word.isalpha():
        return "A" if word.isupper() and len(word) > 1 else "a"
    w = _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return _DIGIT.sub("9", w)


class _Pairs(dict):
    """Word -> its two features, filled as asked: low half the word's, high half the shape's."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        mask = (1 << BITS) - 1
        s = hash_of("\0" + shape(word)) & mask | 1 << BITS
        v = hash_of(word.lower()) & mask | s << 32
        if len(word) <= LONGEST:
            self[word] = v
        return v


def hash_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


_pairs = _Pairs()
remembers("quality", _pairs.clear)
#: Word buckets, then shape buckets, then the repeat share.
WIDTH = (1 << BITS + 1) + 1


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of a text; none for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    both = np.fromiter(map(_pairs.__getitem__, words), np.int64, n)
    ids, counts = np.unique(np.concatenate([both & 0xFFFFFFFF, both >> 32]), return_counts=True)
    repeats = int((both[1:] == both[:-1]).sum())
    values = counts / n * np.where(ids >= 1 << BITS, SHAPE, 1.0)
    return np.append(ids, WIDTH - 1), np.append(values, REPEAT * repeats / n).astype(np.float32)


class Ordinal:
    """Cumulative-link model: weights, ordered thresholds and the grades between them."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, sample_weight: np.ndarray, grades: list[int]) -> Ordinal:
        """Adam on the weighted negative log likelihood; thresholds are a start plus positive gaps."""
        w, m = np.zeros(WIDTH), len(grades) - 1
        if m < 1:
            return cls(w.astype(np.float32), np.zeros(0), grades)
        level = np.searchsorted(grades, y)
        row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        ids, values = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
        sw = sample_weight / sample_weight.sum()
        above = np.array([np.sum(sw[level > j]) for j in range(m)]).clip(1e-4, 1 - 1e-4)
        cut = -np.log(above / (1 - above))
        raw = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
        state = [np.zeros(WIDTH + m), np.zeros(WIDTH + m)]
        for step in range(1, STEPS + 1):
            gaps = np.exp(raw[1:])
            t = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
            x = np.bincount(row, values * w[ids], len(rows))
            # P(level = l) = F(x - t_{l-1}) - F(x - t_l), with F(x - t_{-1}) = 1 and F(x - t_m) = 0
            tail = 1 / (1 + np.exp(-np.clip(x[:, None] - t[None, :], -35, 35)))
            full = np.concatenate([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))], axis=1)
            at = np.arange(len(x))
            hi, lo = full[at, level], full[at, level + 1]
            p = np.maximum(hi - lo, 1e-12)
            slope = full * (1 - full)
            gx = -sw * (slope[at, level] - slope[at, level + 1]) / p
            gt = np.zeros((len(x), m + 2))
            gt[at, level] += sw * slope[at, level] / p
            gt[at, level + 1] -= sw * slope[at, level + 1] / p
            gt = gt[:, 1:-1].sum(axis=0)
            g_raw = np.concatenate([[gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * gaps])
            gw = np.bincount(ids, values * gx[row], WIDTH) + RIDGE * w
            g = np.concatenate([gw, g_raw])
            state[0] = 0.9 * state[0] + 0.1 * g
            state[1] = 0.99 * state[1] + 0.01 * g * g
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            w, raw = w - move[:WIDTH], raw - move[WIDTH:]
        t = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        return cls(w.astype(np.float32), t, grades)

    def tails(self, text: str) -> np.ndarray:
        """P(grade > g) for every grade but the last."""
        ids, values = features(text)
        x = float(self.weights[ids] @ values) if len(ids) else 0.0
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -35, 35)))

    def expected(self, tails: np.ndarray) -> float:
        return float(self.grades[0] + np.diff(self.grades) @ tails) if self.grades else 0.0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Ordinal:
    """Fit on labelled rows; no labelled row gives a model without grades.

    Null grades and keys are left out. A key counts once for each grade it has, however often it or its
    grade repeats, with the text whose features are smallest.
    """
    picked, counts = pick(labels, F.col(label_col), id_col, lambda n: max(1, sample // n))
    grades = sorted(counts)
    if picked is None:
        return Ordinal(np.zeros(WIDTH, np.float32), np.zeros(0), [])
    share = max(1, sample // len(grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            made = [features(t) for t in texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["k", "y", "i", "v"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            rows += [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(b.column("i").to_pylist(), b.column("v").to_pylist(), strict=True)]
            y += b.column("y").to_pylist()
        if rows:
            m = Ordinal.fit(rows, np.array(y), np.array([max(1.0, counts[g] / share) for g in y]), grades)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.thresholds.tolist()], pa.list_(pa.float64()))], names=["weights", "thresholds"])

    got = fit_one(docs, picked, id_col, text_col, run, "i v", sample_bytes, fit, "weights binary, thresholds array<double>")
    if not got:
        return Ordinal(np.zeros(WIDTH, np.float32), np.zeros(max(0, len(grades) - 1)), grades)
    return Ordinal(np.frombuffer(got[0].weights, np.float32), np.array(got[0].thresholds), grades)


def score(docs: DataFrame, model: Ordinal, least: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's key, expected_grade, tail_prob = P(grade >= least), keep = tail_prob >= 0.5.

    ``least`` is the highest grade unless given. Cases: null and empty texts have no feature, so the
    thresholds alone decide; a model without grades, or with one, keeps all with probability 1; texts
    count whole; repeated rows stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, _position(model, least)))
    fields = pa.schema([("k", pa.int64()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        m, at = sent.value
        for batch in batches:
            tails = [m.tails(t) for t in texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([m.expected(x) for x in tails], pa.float64()), pa.array([float(x[at]) if at >= 0 else 1.0 for x in tails], pa.float64())], schema=fields)

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, expected_grade double, tail_prob double").withColumn("keep", F.col("tail_prob") >= 0.5).withColumnRenamed("k", id_col)


def _position(model: Ordinal, least: int | None) -> int:
    """Index of the threshold below grade ``least``; -1 if every grade is that high."""
    return (int(np.searchsorted(model.grades, least)) if least is not None else len(model.grades) - 1) - 1 if len(model.thresholds) else -1


def select(docs: DataFrame, model: Ordinal, least: int | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((model, _position(model, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        m, at = sent.value
        for batch in batches:
            yield batch.filter(pa.array([at < 0 or float(m.tails(t)[min(at, len(m.thresholds) - 1)]) >= 0.5 for t in texts(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
