"""Nearest neighbours by cosine: exact for a batch of questions, and approximate by hyperplane buckets.

The scan sends a bounded batch of question vectors to every executor and scores a partition's rows in blocks of
fixed size, of which only what may belong to the k best so far is looked at further. A worker holds one block and
the k best of its questions, and only these are shuffled: what moves is k rows a question and slice of the vectors,
and the more batches there are, the fewer slices each takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Question vectors that are sent out at once; more are taken in as many passes.
BATCH = 2048
#: Questions and rows that are scored at once.
ASKED, ROWS = 256, 1024
#: Tasks for each core that all passes together aim at.
TASKS = 4

#: Whether pairs of (question, row), as positions, may be candidates.
Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class _Nearest:
    """The k nearest rows so far of each question, ties to the smaller id, and room for some more before they are sorted out."""

    def __init__(self, q: np.ndarray, k: int, digits: int):
        self.q, self.k, self.digits, self.width = q, k, digits, 2 * k + 64
        self.d, self.i = np.full((len(q), self.width), np.inf), np.zeros((len(q), self.width), np.int64)
        self.held, self.worst = np.zeros(len(q), np.int64), np.full(len(q), np.inf)

    def look(self, m: np.ndarray, ids: np.ndarray, mine: np.ndarray | None = None, theirs: np.ndarray | None = None, allowed: Allowed | None = None) -> None:
        """Take in rows ``m``; of the questions and rows at these positions only, if they are given."""
        if theirs is not None:
            m, ids = m[theirs], ids[theirs]
        n = len(self.q) if mine is None else len(mine)
        for a in range(0, n, ASKED):
            asked = slice(a, min(n, a + ASKED)) if mine is None else mine[a : a + ASKED]
            s = self.q[asked] @ m.T
            # a distance is off its rounded value by less than a unit of the last digit
            hits = np.flatnonzero(s >= (1 - self.worst[asked] - 10.0**-self.digits)[:, None])
            at, row = np.divmod(hits, len(m))
            d = np.round(1 - s.ravel()[hits], self.digits) + 0.0
            at = at + a if mine is None else asked[at]
            if allowed is not None:
                ok = allowed(at, row if theirs is None else theirs[row])
                at, row, d = at[ok], row[ok], d[ok]
            self._add(at, d, ids[row])

    def _add(self, at: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        while True:
            some = d <= self.worst[at]
            at, d, i = at[some], d[some], i[some]
            if not len(at):
                return
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            slot = self.held[at] + np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            fits = slot < self.width
            self.d[at[fits], slot[fits]], self.i[at[fits], slot[fits]] = d[fits], i[fits]
            self.held += np.bincount(at[fits], minlength=len(self.held))
            if fits.all():
                return
            at, d, i = at[~fits], d[~fits], i[~fits]
            self._settle(np.unique(at))

    def _settle(self, which: np.ndarray) -> None:
        """Keep the k nearest of these questions."""
        for a in range(0, len(which), ASKED):
            w = which[a : a + ASKED]
            d, i = self.d[w], self.i[w]
            kept = np.argpartition(d, self.k - 1, axis=1)[:, : self.k]
            last = np.take_along_axis(d, kept[:, -1:], 1)[:, 0]
            tied = np.flatnonzero(np.isfinite(last) & (np.count_nonzero(d <= last[:, None], axis=1) > self.k))
            kept[tied] = np.lexsort((i[tied], d[tied]), axis=1)[:, : self.k]
            self.d[w, self.k :] = np.inf
            self.d[w, : self.k], self.i[w, : self.k] = np.take_along_axis(d, kept, 1), np.take_along_axis(i, kept, 1)
            self.held[w], self.worst[w] = np.minimum(self.held[w], self.k), last

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of questions, ids and distances, some questions at a time."""
        for a in range(0, len(self.q), ASKED):
            w = np.arange(a, min(len(self.q), a + ASKED))
            self._settle(w)
            at, slot = np.nonzero(np.isfinite(self.d[w, : self.k]))
            yield at + a, self.i[w[at], slot], self.d[w[at], slot]


def _sides(m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bucket of each row in each table, as ``buckets`` has it."""
    tables, bits, dims = planes.shape
    above = (m @ planes.reshape(-1, dims).T > 0).reshape(len(m), tables, bits)
    return above @ (1 << np.arange(bits))


def top_k(vectors: DataFrame, questions: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", query_vector: str = "vector", digits: int = 6, exclude: tuple[str, str] | None = None, same: tuple[str, str] | None = None, planes: np.ndarray | None = None) -> DataFrame:
    """(query_id, rank, id, dist): the k nearest by cosine distance rounded to ``digits``, ties to the smaller id.

    ``exclude`` names a column of the vectors and one of the questions: rows whose values are equal are no
    candidates of that question. ``same`` names such a pair too: only rows whose values are equal (and not
    null) are candidates. With ``planes`` (tables, bits, dims) only rows that share a bucket with the question,
    in any table or one bit away, are candidates. Rows with a null id or vector take no part. Vectors must have
    one length.
    """
    if exclude and same:
        raise ValueError("exclude and same exclude each other")
    mine, asks = exclude or same or (None, None)
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"), (F.col(mine).cast("string") if mine else F.lit(None).cast("string")).alias("x")).where("i IS NOT NULL AND v IS NOT NULL")
    asked = questions.select(F.col(query_col).cast("long").alias("q"), F.col(query_vector).alias("v"), (F.col(asks).cast("string") if asks else F.lit(None).cast("string")).alias("x")).where("v IS NOT NULL")
    spark = vectors.sparkSession

    def send(batch: list):
        return spark.sparkContext.broadcast((np.array([r[0] for r in batch]), np.array([[float(x) for x in r[1]] for r in batch]), [r[2] for r in batch]))

    def one_pass(sent, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, apart = sent.value
            best, seen = _Nearest(_unit(q), k, digits), 0
            number = {x: n for n, x in enumerate(dict.fromkeys(apart))}
            of = np.array([number[x] for x in apart])
            members = [np.flatnonzero(of == n) for n in range(len(number))] if same else []
            sides = None if planes is None else _sides(q, planes)
            for b in batches:
                at = 0
                while at < b.num_rows:
                    # few rows at first, so that few are taken in before there is a kth distance
                    part = b.slice(at, min(ROWS, max(2 * k, seen)))
                    at, seen = at + part.num_rows, seen + part.num_rows
                    raw = _matrix(part.column("v"))
                    m, i = _unit(raw), part.column("i").to_numpy()
                    theirs = np.array([number.get(x, -1) for x in part.column("x").to_pylist()]) if exclude or same else None
                    tests: list[Allowed] = []
                    if exclude:
                        tests.append(lambda a, r, theirs=theirs: of[a] != theirs[r])
                    if planes is not None:
                        tests.append(lambda a, r, own=_sides(raw, planes): _close(sides[a] ^ own[r]))
                    allowed = (lambda a, r, tests=tests: np.logical_and.reduce([t(a, r) for t in tests])) if tests else None
                    if same:
                        for n in np.unique(theirs[theirs >= 0]):
                            if apart[members[n][0]] is not None:
                                best.look(m, i, members[n], np.flatnonzero(theirs == n), allowed)
                    else:
                        best.look(m, i, allowed=allowed)
            for a, i, d in best.found():
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(i), pa.array(d)], names=["query_id", "i", "dist"])

        return rows.mapInArrow(run, "query_id long, i long, dist double")

    sent, held = [], []
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == BATCH:
            sent, held = [*sent, send(held)], []
    if held:
        sent.append(send(held))
    # many passes fill the cores with few slices each, and so each question has few lists to merge
    slices = max(2, -(-TASKS * spark.sparkContext.defaultParallelism // max(1, len(sent))))
    found = spark.createDataFrame([], "query_id long, i long, dist double") if not sent else None
    for s in sent:
        made = one_pass(s, rows.coalesce(slices))
        found = made if found is None else found.unionByName(made)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "i")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("i").alias(id_col), "dist")


def _close(x: np.ndarray) -> np.ndarray:
    """Whether any number of a row has one bit at most."""
    return ((x & (x - 1)) == 0).any(axis=1)


def live_top_k(vectors: DataFrame, locations: DataFrame, questions: DataFrame, n: int, where: Column | None = None, overfetch: int = 2, id_col: str = "vec_id", **names: str) -> DataFrame:
    """Locations of the nearest vectors that have one: (query_id, rank, location columns, dist).

    Unfiltered, the nearest ``overfetch * n`` vectors with a location are ranked first and their locations
    joined after; with a filter on locations, the scan is over the vectors that pass it.
    """
    kept = locations if where is None else locations.where(where)
    live = vectors.join(kept.select(id_col).distinct(), id_col, "left_semi")
    near = top_k(live, questions, overfetch * n, id_col=id_col, **names).drop("rank")
    fanned = near.join(kept, id_col)
    ranked = fanned.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "path", "start_line", id_col)))
    return ranked.where(F.col("rank") <= n)


def _planes(tables: int, bits: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dims))


def buckets(vectors: DataFrame, tables: int, bits: int, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64) -> DataFrame:
    """(table, bucket, id): the signs of random projections, as columns of plain arithmetic."""
    planes = _planes(tables, bits, dims, seed)
    v = F.col("v")
    sides = []
    for t in range(tables):
        parts = [F.when(F.aggregate(F.zip_with(v, F.array(*map(F.lit, planes[t, b].tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(bits)]
        sides.append(F.struct(F.lit(t).alias("table"), sum(parts[1:], parts[0]).alias("bucket")))
    rows = vectors.select(F.col(id_col), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    return rows.select(id_col, F.explode(F.array(*sides)).alias("s")).select("s.table", "s.bucket", id_col)


def approximate_top_k(vectors: DataFrame, questions: DataFrame, k: int, tables: int = 16, bits: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", query_vector: str = "vector", dims: int = 64) -> DataFrame:
    """As ``top_k`` over the rows that share a bucket with the question, in any table or one bit away.

    The pairs of a bucket are never made: with few and full buckets they are most of all pairs, several times
    over. The scan tests the buckets of those rows that may belong to the k nearest.
    """
    return top_k(vectors, questions, k, id_col, vector_col, query_col, query_vector, planes=_planes(tables, bits, dims))
