"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within two bits are found without comparing all pairs. The 64 bits are cut into two
segments, fewer than the three that would leave one of them equal, so one segment differs by at most one
bit. Indexed are the variants of the upper segment with one bit as a wildcard, and both segments as they
are. For a pair that differs by a bits above and b below, a + b <= 2:

* a = 0: the upper segments are equal;   * b = 0: the lower segments are equal;
* a = b = 1: the variant of the upper segment with the differing bit as wildcard is equal.

So 34 signatures a fingerprint find every pair. They are joined by equality (dealt by signature and
sorted), each bucket verifies the true distance and emits only a spanning forest of its links, never all
pairs. Only distinct fingerprints are indexed, so copies do not swell a bucket. A segment value with very
many fingerprints is cut again by halves of the other segment, which bounds a bucket by 2^18.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import claim, utf8, with_column, written
from lodestone.llm.components import components

SEED = 42
#: Fingerprints of one segment value beyond which its buckets are cut again.
HOT = 1 << 17
#: Bucket size up to which all pairs inside are looked at in blocks of a matrix.
SMALL = 2048
_LOW = np.uint64(0xFFFFFFFF)
_SINGLE = [1 << i for i in range(32)]
_PAIRS = [a | b for i, a in enumerate(_SINGLE) for b in _SINGLE[:i]]


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of UTF-8 text: A-Z lower-cased, ASCII white space between words, shingles with repeats."""
    parts = text.lower().split()  # of bytes: touches ASCII only
    if len(parts) < words:
        hashes = np.fromiter([xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else [], np.uint64)
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), np.uint64, len(parts) - words + 1)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text as a signed 64-bit number; null text has no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in utf8(batch.column(text_col))), np.uint64, batch.num_rows)
            yield with_column(batch, out, pa.array(found.view(np.int64)))

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0).cast("long")).schema)


def _forest(fps: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect, as closely as all pairs within two bits do, a bucket's fingerprints.

    fps: sorted and distinct. kind: 0-31 wildcard of the upper segment, 32 upper equal, 33 lower equal.
    """
    n = len(fps)
    root = np.arange(n)
    if n <= SMALL:
        while True:
            new = root.copy()
            for at in range(0, n, 256):
                near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= 2
                new[at : at + 256] = np.where(near, root[None, :], n).min(axis=1)
            new = new[new]
            if (new == root).all():
                break
            root = new
    else:
        if kind < 32:
            masks = [1 << (32 + kind) | m for m in [0, *_SINGLE]]
        else:
            masks = [m << (32 * (kind == 33)) for m in [*_SINGLE, *_PAIRS]]
        pairs = []
        for m in masks:
            other = fps ^ np.uint64(m)
            at = np.searchsorted(fps, other)
            hit = np.flatnonzero((at < n) & (fps[np.minimum(at, n - 1)] == other))
            pairs.append(np.stack([hit, at[hit]], axis=1)[hit < at[hit]])
        a, b = np.concatenate(pairs).T
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    far = np.flatnonzero(root != np.arange(n))
    return fps[far], fps[root[far]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, sub, fp), sorted by these within a partition -> links; a bucket may span batches."""
    carried: list[np.ndarray] | None = None

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def buckets(cols: list[np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        if len(two):
            u, v = cols[3][two], cols[3][two + 1]
            near = np.bitwise_count(u ^ v) <= 2
            yield out(u[near], v[near])
        for a, b in zip(edges[:-1][sizes > 2].tolist(), edges[1:][sizes > 2].tolist(), strict=True):
            yield out(*_forest(np.sort(cols[3][a:b]), int(cols[0][a])))

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols[3] = cols[3].view(np.uint64)
        if carried is not None:
            cols = [np.concatenate(x) for x in zip(carried, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        edges = np.concatenate([[0], new])
        yield from buckets(cols, edges)
        carried = [c[edges[-1] :] for c in cols]
    if carried is not None:
        yield from buckets(carried, np.array([0, len(carried[0])]))


def near_links(fingerprints: DataFrame, hot: int = HOT) -> DataFrame:
    """``(fp)``, distinct -> links ``(u, v)`` with the same components as all pairs within two bits."""
    rows = fingerprints.select("fp", F.shiftrightunsigned("fp", 32).alias("a"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"))
    keys = "concat(transform(sequence(0, 31), v -> struct(v AS kind, a & ~shiftleft(1L, v) AS key)), array(struct(32 AS kind, a AS key), struct(33 AS kind, b AS key)))"
    signed = rows.selectExpr("fp", f"inline({keys})").select("kind", "key", F.lit(0).cast("long").alias("sub"), "fp")
    values = rows.selectExpr("inline(array(struct(32 AS kind, a AS value), struct(33 AS kind, b AS value)))")
    crowded = values.groupBy("kind", "value").count().where(F.col("count") > hot).select("kind", "value")
    if not crowded.isEmpty():
        # every bucket that a crowded value lies in is cut again, by halves of the other segment: equal
        # upper (lower) segments leave two bits to the other, so one half differs by one bit at most, and a
        # wildcard leaves one, so one half is equal
        again = crowded.where("kind = 33").select("kind", F.col("value").alias("key")).unionByName(
            crowded.where("kind = 32").selectExpr("inline(concat(transform(sequence(0, 31), v -> struct(v AS kind, value & ~shiftleft(1L, v) AS key)), array(struct(32 AS kind, value AS key))))")).distinct()
        other = "CASE WHEN kind = 33 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
        exact = "array(shiftleft(1L, 40) | (o & 65535L), shiftleft(2L, 40) | shiftrightunsigned(o, 16))"
        wild = "flatten(transform(sequence(0, 15), w -> array(shiftleft(3L + w, 40) | (o & 65535L & ~shiftleft(1L, w)), shiftleft(19L + w, 40) | (shiftrightunsigned(o, 16) & ~shiftleft(1L, w)))))"
        cut = signed.join(again, ["kind", "key"], "left_semi").withColumn("o", F.expr(other)).select("kind", "key", F.explode(F.expr(f"CASE WHEN kind < 32 THEN {exact} ELSE {wild} END")).alias("sub"), "fp")
        signed = signed.join(again, ["kind", "key"], "left_anti").unionByName(cut)
    dealt = signed.repartition(F.col("kind"), F.col("key"), F.col("sub")).sortWithinPartitions("kind", "key", "sub", "fp")
    return dealt.mapInArrow(_links, "u long, v long")


def components_of(prints: DataFrame, id_col: str, fp_col: str, hot: int = HOT) -> DataFrame:
    """Written ``(id, fp)`` rows -> ``(fp, component_id)`` for every distinct fingerprint.

    component_id is the smallest id (nulls last) that the fingerprint reaches.
    """
    firsts = prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first"))
    roots = components(near_links(firsts.select("fp"), hot))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Each row's key, fingerprint (16 hex digits) and component (smallest key reachable, itself included).

    Cases: null or empty texts have fingerprint zero and link like any other; repeated rows come out as
    often as they came in; a null key takes the smallest other key of its component, or null; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    prints = written(with_fingerprints(rows, words, "t", "fp").select("k", "fp"), "fingerprints")[0]
    found = components_of(prints, "k", "fp", hot)
    return prints.join(found, "fp").select(F.col("k").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row of each component: the one with the smallest key (any one of them, if that repeats).

    All columns stay. Cases as in ``near_duplicates``; of a component with null keys only, one row stays.
    """
    fp = "__ls_fp"
    # written with their texts: fingerprints are made once
    marked = written(with_fingerprints(docs, words, text_col, fp), "fingerprints")[0]
    prints = marked.select(F.col(id_col).alias("k"), F.col(fp).alias("fp"))
    return first_rows(docs, marked, prints, components_of(prints, "k", "fp", hot), id_col, fp)


def first_rows(docs: DataFrame, marked: DataFrame, prints: DataFrame, found: DataFrame, id_col: str, fp: str) -> DataFrame:
    """The row with the smallest key of each component.

    marked: ``docs`` with column ``fp``; prints: its written ``(k, fp)``; found: ``(fp, component_id)``.
    """
    mine, rows_col = "__ls_component", "__ls_rows"
    # the fingerprint breaks ties between rows of one key
    counted = prints.groupBy("k", "fp").agg(F.count(F.lit(1)).alias("n")).join(found, "fp")
    order = F.struct(F.col("k").isNull().alias("none"), "k", "fp", "n")
    firsts, _ = written(counted.groupBy(F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).alias("c")).agg(F.min(order).alias("first")).select(F.col("first.k").alias(mine), F.col("first.fp").alias("__ls_fp2"), F.col("first.n").alias(rows_col)), "kept")
    kept = marked.join(firsts, marked[id_col].eqNullSafe(firsts[mine]) & (marked[fp] == firsts["__ls_fp2"]))
    if firsts.where(F.col(rows_col) > 1).isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(rows_col) == 1).select(*docs.columns)
    return once.unionByName(kept.where(F.col(rows_col) > 1).dropDuplicates([mine, "__ls_fp2"]).select(*docs.columns))
