"""Exact top-k by inner product: a dual-tree search with cover trees, over blocks dealt by nearest pivot.

Rows are dealt to the nearest of some pivots (rows themselves), so that a block is a ball: a pivot and a covering
radius. For a query node (centre q, covering radius r) and a candidate node (centre p, radius s) no pair
below them scores over

    <q, p> + r |p| + s |q| + r s,

so a pair of nodes is dropped when this is less than the worst kth score of the query node's group. The
bound is used twice. First over blocks, before rows are copied: each query is searched in one block of its
own pivot, which gives its group a kth score to beat, and goes only to blocks whose bound reaches it. Then
inside a task: queries and candidates are indexed by cover trees, and both trees are walked together.

Candidates are shuffled once, to the task of their block; queries are copied to the blocks that they need
and stream past in groups of one pivot. If bounds prune nothing, each query goes to every block, as any
exact search must then do; a block of candidates and a group of queries are bounded in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import written

#: Rows in a block of candidates, and queries that are walked with it at once.
CANDIDATES, QUERIES = 8192, 2048
#: Pivots at most; more rows a pivot make more blocks of that pivot. Pivots are sent to every executor.
PIVOTS = 1024
#: A node with so few rows below is not split.
LEAF = 32


class CoverTree:
    """Nodes with a centre (a row), the rows below, a covering radius and children at half the radius."""

    __slots__ = ("centre", "rows", "radius", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int):
        local = points[rows]
        norms = np.square(local).sum(axis=1)

        def away(i: int) -> np.ndarray:
            """Distances of the rows from row i of them."""
            return np.sqrt(np.maximum(norms + norms[i] - 2 * (local @ local[i]), 0))

        at = int(np.flatnonzero(rows == centre)[0])
        far = away(at)
        self.centre, self.rows, self.radius, self.children = centre, rows, float(far.max(initial=0.0)), []
        if len(rows) <= LEAF or self.radius == 0:
            return
        # children: centres over half the radius apart (separation) that cover every row within it
        free, lone = np.ones(len(rows), bool), []
        while True:
            mine = np.flatnonzero((far <= self.radius / 2) & free)
            free[mine] = False
            if len(mine) > 1:
                self.children.append((int(rows[at]), rows[mine]))
            else:
                lone.append(int(rows[at]))
            at += int(free[at:].argmax()) if free[at:].any() else len(rows)
            if at >= len(rows):
                at = int(free.argmax())
                if not free[at]:
                    break
            far = away(at)
        self.children = [CoverTree(points, r, c) for c, r in self.children]
        if lone:  # single rows are kept together: their radius is 0 each
            self.children.append(_Singles(np.array(lone)))


class _Singles:
    """Children of radius 0."""

    __slots__ = ("rows",)

    def __init__(self, rows: np.ndarray):
        self.rows = rows


def _flat(node: CoverTree | _Singles) -> list[CoverTree | _Singles]:
    return node.children if isinstance(node, CoverTree) and node.children else [node]


class _Best:
    """The k best (score, id) of each query, ties to the smaller id.

    ``floor`` are scores that a result must reach to matter, if they are known from elsewhere.
    """

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(queries, -np.inf) if floor is None else floor
        self.pairs = 0
        self.score = np.full((queries, k), -np.inf)
        self.row = np.full((queries, k), -1, np.int64)

    def add(self, q: np.ndarray, rows: np.ndarray, scores: np.ndarray, order: np.ndarray) -> None:
        """scores: q x rows. order: position of each row by id, of all rows."""
        score = np.concatenate([self.score[q], scores], axis=1)
        row = np.concatenate([self.row[q], np.broadcast_to(rows, scores.shape)], axis=1)
        if score.shape[1] > 4 * self.k:
            # the kth best score bounds what matters; all ties with it stay
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
            most = int((score >= kth[:, None]).sum(axis=1).max())
            part = np.argpartition(-score, min(most, score.shape[1]) - 1, axis=1)[:, :most]
            score, row = np.take_along_axis(score, part, 1), np.take_along_axis(row, part, 1)
        place = np.where(row >= 0, order[row], len(order))
        best = np.lexsort((place, -score), axis=1)[:, : self.k]
        self.score[q], self.row[q] = np.take_along_axis(score, best, 1), np.take_along_axis(row, best, 1)

    def worst(self, q: np.ndarray) -> float:
        """The least score that may still enter the lists of these queries."""
        return float(np.maximum(self.score[q, -1], self.floor[q]).min())


def _walk(q: CoverTree | _Singles, c: CoverTree | _Singles, qv: np.ndarray, cv: np.ndarray, best: _Best, same: np.ndarray, order: np.ndarray) -> None:
    """same: for each query its own row among the candidates, or -1."""
    stack = [(np.inf, q, c)]
    while stack:
        bound, q, c = stack.pop()
        if bound < best.worst(q.rows):  # an equal bound may still win a tie
            continue
        qs, cs = _flat(q), _flat(c)
        if qs == [q] and cs == [c]:
            scores = qv[q.rows] @ cv[c.rows].T
            scores[same[q.rows, None] == c.rows[None, :]] = -np.inf
            best.pairs += scores.size
            best.add(q.rows, c.rows, scores, order)
            continue
        found = []
        for a in qs:
            q0, r = (qv[a.centre], a.radius) if isinstance(a, CoverTree) else (None, 0.0)
            for b in cs:
                if q0 is None or not isinstance(b, CoverTree):
                    # single rows have no common centre: bound by norms
                    top = _norms(qv, a).max() * _norms(cv, b).max()
                else:
                    p0, s = cv[b.centre], b.radius
                    top = q0 @ p0 + r * np.sqrt(p0 @ p0) + s * np.sqrt(q0 @ q0) + r * s
                found.append((_over(top), a, b))
        stack += sorted(found, key=lambda x: x[0])  # the best bound is walked first


def _over(bound: float) -> float:
    """The bound with room for rounding, upwards whatever its sign."""
    return float(bound) + abs(float(bound)) * 1e-12 + 1e-6


def _norms(v: np.ndarray, node: CoverTree | _Singles) -> np.ndarray:
    rows = node.rows
    return np.sqrt(np.square(v[rows]).sum(axis=1))


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None, floor: np.ndarray | None = None, tree: CoverTree | None = None, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, positions among points) of each query's k best; -inf and -1 fill up. Exact below 2^53.

    own: each query's own row among the points, or -1. floor: scores below it may be missing. tree: of the
    points, if it is made already. counted: the number of pairs that were scored is added to it.
    """
    best = _Best(len(queries), k, floor)
    if len(queries) and len(points):
        order = np.empty(len(ids), np.int64)
        order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        same = np.full(len(queries), -1) if own is None else own
        _walk(CoverTree(queries, np.arange(len(queries)), 0), tree or CoverTree(points, np.arange(len(points)), 0), queries, points, best, same, order)
    if counted is not None:
        counted.append(best.pairs)
    return best.score, best.row


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class _Pivots:
    """Pivots by length of vector."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(v) for _, v in rows}):
            some = [(i, v) for i, v in rows if len(v) == n]
            self.by_dims[n] = np.array([i for i, _ in some]), np.array([v for _, v in some]).reshape(len(some), n)

    def centre(self, dims: int, cell: int) -> np.ndarray:
        """The centre of a cell; rows of a length without a pivot are cell -1 around zero."""
        if cell < 0:
            return np.zeros(dims)
        cells, at = self.by_dims[dims]
        return at[np.searchsorted(cells, cell)]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of every row."""
        if v.shape[1] not in self.by_dims:
            return np.full(len(v), -1), np.sqrt(np.square(v).sum(axis=1))
        cells, at = self.by_dims[v.shape[1]]
        d = np.square(v).sum(axis=1)[:, None] + np.square(at).sum(axis=1)[None, :] - 2 * v @ at.T
        best = d.argmin(axis=1)
        return cells[best], np.sqrt(np.square(v - at[best]).sum(axis=1))


def _deal(rows: DataFrame, pivots) -> DataFrame:
    """``rows`` with cell and distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            dims = b.column("dims").to_numpy()
            for n in np.unique(dims):
                for at in range(0, b.num_rows, 1024):
                    mine = at + np.flatnonzero(dims[at : at + 1024] == n)
                    cell[mine], far[mine] = pivots.value.nearest(_matrix(b.column("v").take(pa.array(mine))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    return rows.mapInArrow(run, "i long, v array<double>, dims int, row long, cell int, far double")


def _walked(tasks: DataFrame, k: int, pairs: bool = False) -> DataFrame:
    """Rows (dims, cell, part, asks, i, v, row, floor) of candidates (asks 0) and queries (asks 1) -> partial results.

    They are brought together by block and sorted, candidates first; queries stream past in groups. With
    ``pairs`` the result is the number of scored pairs instead.
    """
    names = ["query_id", "row", "vec", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple | None = None
        points: list[pa.RecordBatch] = []
        made: list = []
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if held and points:
                if not made:
                    c = pa.Table.from_batches(points)
                    v, ids, rows = _matrix(c["v"].combine_chunks()), c["i"].to_numpy(), c["row"].to_numpy()
                    order = np.argsort(rows, kind="stable")
                    made.append((v, ids, rows[order], order, CoverTree(v, np.arange(len(v)), 0)))
                v, ids, sorted_rows, order, tree = made[0]
                q = pa.Table.from_batches(held)
                qi, qr = q["i"].to_numpy(), q["row"].to_numpy()
                at = np.minimum(np.searchsorted(sorted_rows, qr), len(sorted_rows) - 1)
                own = np.where(sorted_rows[at] == qr, order[at], -1)
                scored: list[int] = []
                scores, found = search(_matrix(q["v"].combine_chunks()), qi, v, ids, k, own, q["floor"].to_numpy(), tree, scored)
                x, j = np.nonzero(np.isfinite(scores))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(scored)] * 4, names=names)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(qi[x]), pa.array(qr[x]), pa.array(ids[found[x, j]]), pa.array(scores[x, j].astype("int64"))], names=names)
            held, count = [], 0

        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("dims", "cell", "part", "asks", "home")])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                now = tuple(keys[:3, start].tolist())
                if now != block:
                    yield from flush()
                    block, points, made = now, [], []
                if not keys[3, start]:
                    points.append(b.slice(start, end - start))
                    continue
                for at in range(start, end, QUERIES):
                    some = b.slice(at, min(QUERIES, end - at))
                    if held and (count + some.num_rows > QUERIES or held[0].column("home")[0] != some.column("home")[0]):
                        yield from flush()
                    held.append(some)
                    count += some.num_rows
        yield from flush()

    dealt = tasks.repartition("dims", "cell", "part").sortWithinPartitions("dims", "cell", "part", "asks", "home")
    return dealt.mapInArrow(run, "query_id long, row long, vec long, score long")


def _reach(groups: DataFrame, cells: DataFrame, pivots) -> DataFrame:
    """Groups of queries (dims, home, sub, radius, worst) -> (dims, home, sub, cell) that their bounds do not exclude.

    ``cells`` (dims, cell, radius) are at most PIVOTS + the lengths of vectors, and are sent to every executor.
    """
    sent = groups.sparkSession.sparkContext.broadcast([tuple(r) for r in cells.select("dims", "cell", "radius").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dims = {}
        for n in {d for d, _, _ in sent.value}:
            mine = [(c, s) for d, c, s in sent.value if d == n]
            by_dims[n] = np.array([c for c, _ in mine]), np.stack([pivots.value.centre(n, c) for c, _ in mine]), np.array([s for _, s in mine])
        for b in batches:
            out = []
            for n, home, sub, r, worst in zip(*(b.column(c).to_pylist() for c in ("dims", "home", "sub", "radius", "worst")), strict=True):
                cell, p, s = by_dims[n]
                q = pivots.value.centre(n, home)
                top = p @ q + r * np.sqrt(np.square(p).sum(axis=1)) + s * np.sqrt(q @ q) + r * s
                out += [(n, home, sub, c) for c in cell[top + np.abs(top) * 1e-12 + 1e-6 >= worst].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["dims", "home", "sub", "cell"])

    return groups.select("dims", "home", "sub", "radius", "worst").mapInArrow(run, "dims int, home int, sub int, cell int")


def _plan(vectors: DataFrame, is_query, k: int, id_col: str, vector_col: str, scale: float) -> tuple[DataFrame, DataFrame]:
    """(partial results of the own blocks, rows of the other tasks)."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("i"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.size(v).alias("dims"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")[0]
    n = rows.count()
    # a bounded number of rows, by hash
    some = rows.orderBy(F.xxhash64("i", "row"), "row").limit(min(PIVOTS, -(-n // CANDIDATES) * 4)).select("v").collect() if n > CANDIDATES else []
    pivots = vectors.sparkSession.sparkContext.broadcast(_Pivots([(i, r["v"]) for i, r in enumerate(some)]))
    dealt = written(_deal(rows, pivots), "dealt")[0]
    cells = dealt.groupBy("dims", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    cells = written(cells.withColumn("parts", F.ceil(F.col("n") / CANDIDATES).cast("int")), "cells")[0]
    spread = lambda m: F.pmod(F.xxhash64("row"), m).cast("int")
    # cells are few: at most the pivots, and one more for each length without a pivot
    placed = dealt.join(cells.select("dims", "cell", "parts"), ["dims", "cell"])
    points = placed.select("dims", "cell", spread(F.col("parts")).alias("part"), F.lit(0).alias("asks"), F.lit(0).alias("home"), "i", "v", "row", F.lit(0.0).alias("floor"))
    asked = placed.where(is_query(F.col("i")))
    first = asked.select("dims", "cell", F.lit(0).alias("part"), F.lit(1).alias("asks"), F.col("cell").alias("home"), "i", "v", "row", F.lit(float("-inf")).alias("floor"))
    seeds = written(_walked(points.where("part = 0").unionByName(first), k), "seeds")[0]
    # what a query must beat: its kth score so far
    kth = seeds.groupBy("row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found")).where(F.col("found") >= k).select("row", F.col("least").cast("double").alias("floor"))
    homes = asked.withColumnRenamed("cell", "home").join(kth, "row", "left").select("dims", "home", spread(F.greatest(F.lit(1), F.col("parts"))).alias("sub"), "i", "v", "row", "far", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    homes = written(homes, "homes")[0]
    groups = homes.groupBy("dims", "home", "sub").agg(F.max("far").alias("radius"), F.min("floor").alias("worst"))
    need = _reach(groups, cells, pivots).join(cells.select("dims", "cell", "parts"), ["dims", "cell"])
    need = need.select("dims", "home", "sub", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).where("home <> cell OR part > 0")
    copies = homes.join(need, ["dims", "home", "sub"]).select("dims", "cell", "part", F.lit(1).alias("asks"), "home", "i", "v", "row", "floor")
    return seeds, points.unionByName(copies)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, id, score.

    Components x become floor(scale * x). Candidates are all rows but the query's own; a row of another
    length than the query's does not compare with it.

    Cases: vectors that are null or hold a null, NaN or infinite component take no part; a query with
    fewer than k candidates returns them all; repeated rows are candidates and queries each on their own;
    scores are exact while their magnitude stays below 2^53; an empty table gives an empty result.
    """
    seeds, tasks = _plan(vectors, is_query, k, id_col, vector_col, scale)
    partial = seeds.unionByName(_walked(tasks, k))
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")


def scored_share(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> float:
    """The share of all pairs of a query and a row that are scored after the first block."""
    _, tasks = _plan(vectors, is_query, k, id_col, vector_col, scale)
    scored = _walked(tasks, k, pairs=True).agg(F.sum("score")).first()[0] or 0
    return scored / max(1, vectors.where(is_query(F.col(id_col))).count() * vectors.count())


#: DuckDB SQL for ``top_k`` of every 50th row of ``embeddings``.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row_no AS q_row, c.vec_id, list_inner_product(q.c, c.c)::BIGINT AS score
  FROM v q JOIN v c ON q.row_no <> c.row_no AND len(q.c) = len(c.c) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, q_row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
