"""Near copies by the exact Jaccard similarity of word shingle sets.

Pairs come from SimHash fingerprints by deletion-variant signatures, as in ``simhash``, over 256 bits of the
five-word shingle sets. At a similarity of 0.8 fingerprints differ in about 39 bits, so they are cut into 16 segments, and a
signature is a segment with one bit as a wildcard: two sets have one in common where a segment differs by one bit at
most. That holds for all pairs within 31 bits and, were the bits independent, for 99 of 100 pairs at 0.8 (more above). The true
distance is verified in the signature's bucket, and each set keeps the nearest sets on either side within REACH; the
similarity of these pairs is then computed from the whole sets.

No number of segments that leaves buckets small is sure to reach 0.8, so what signatures leave open is decided exactly, by
a prefix filter over sets that they left in different components: two sets of similarity t or more share a shingle
among the first n - ceil(t n) + 1 of each, n its size, whatever the order is that all sets are sorted by. The order is by
hash, with shingles that are common in a sample of the texts at the end; the sample only makes buckets small and loses no
pair. Shingles that two sets have in their prefixes are buckets; of buckets with the same sets one is enough.

So what signatures find decides the work of the second round and never the result, and a large group of copies does not
make all its pairs. The second round takes a pair once if it
can: buckets have an order, large ones first, and each set knows its first ones; where two sets have one of these in
common, later buckets pass the pair over. The first bucket that two sets share has none before it, so it never does.

A pair is looked at inside its bucket, by numbers the sets carry, and leaves it only if none of these exclude it:

* sizes and positions bound the shingles the sets have in common;
* parities of the shingles in 512 bins (hashed) that differ are at most as many as shingles in one set alone;
* the first 128 bits of the fingerprints differ by FAR at most: at the similarity sought a bit differs with a
  probability of 0.19 at most, so that more are over six deviations away.

A pair that is left is a link only if its similarity, computed from the whole sets, is enough.
Equal sets are one node throughout; the text of one of them stands for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import claim, forget, utf8, with_column, written
from lodestone.llm.components import components
from lodestone.llm.decontaminate import _hashes, _shingles
from lodestone.llm.simhash import first_rows

WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles are counted for the order, and shingles at most that it puts at the end.
SAMPLE, COMMON = 10_000, 100_000
#: Bits of the first 128 in which the fingerprints of a pair may differ. Unrelated pairs differ in 64 on average.
FAR = 52
#: Numbers of 64 bits of a set: two of its fingerprint and eight of its parities, which buckets carry, and the rest of its fingerprint.
PRINT, FINGERPRINT = [f"s{i}" for i in range(10)], ["s0", "s1", "s10", "s11"]
NUMBERS = [*PRINT, "s10", "s11"]
#: Bits of all 256 in which a pair that signatures find may differ, as in ``decontaminate``. Unrelated pairs differ in 128 on average.
REACH = 63
#: Sets of a signature's bucket that each set is compared with on either side; the prefix filter decides on those further off.
WINDOW = 1024
_ROW = "h long, fp long, n long, pos long"


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of UTF-8 text's shingles: A-Z lower-cased, ASCII white space between words."""
    return np.unique(_shingles(_hashes(text.lower().split()), words))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def _least(n: int, similarity: float) -> int:
    """Shingles of n that a set of that similarity has at least."""
    return math.ceil(similarity * n - 1e-9)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=names)


def _print(shingles: np.ndarray) -> tuple[int, ...]:
    """SimHash of a set (256 bits) and the parities of its shingles in 512 bins, as signed numbers (``NUMBERS``)."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 8192):
        signs = [shingles[at : at + 8192]]
        for factor in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD):
            x = (signs[-1] ^ (signs[-1] >> np.uint64(31))) * np.uint64(factor)
            signs.append(x ^ (x >> np.uint64(29)))
        ones += np.unpackbits(np.stack(signs, axis=1).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    odd = np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    bits = 2 * ones > len(shingles)
    return tuple(np.packbits(np.concatenate([bits[:128], odd > 0, bits[128:]]), bitorder="little").view(np.int64).tolist())


def with_nodes(docs: DataFrame, words: int, text_col: str, out: str) -> DataFrame:
    """``docs`` with a 64-bit digest of each text's shingle set, and (``out`` and a digit) its numbers by ``_print``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_copies")
        for batch in batches:
            made = [(_node(s := shingle_set(t, words)), *_print(s)) for t in utf8(batch.column(text_col))]
            found = np.array([m[0] for m in made], np.uint64).view(np.int64)
            batch = with_column(batch, out, pa.array(found))
            for part in range(len(NUMBERS)):
                batch = with_column(batch, f"{out}{part}", pa.array([m[1 + part] for m in made], pa.int64()))
            yield batch

    added = {c: F.lit(0).cast("long") for c in (out, *(f"{out}{part}" for part in range(len(NUMBERS))))}
    return docs.mapInArrow(run, docs.withColumns(added).schema)


def _common(rows: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that three or more of a sample of the distinct texts hold."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < math.ceil(1_000_000 * SAMPLE / n)) if n > SAMPLE else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in utf8(batch.column("t")):
                yield _batch([shingle_set(t, words)], ["h"])

    found = some.select("t").distinct().mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON)
    return np.sort(np.array([r.h for r in found.collect()], np.int64).view(np.uint64))


def _prefixes(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(t, fp)`` -> a row for each shingle in the prefix of a set: h, fp, size n, position."""
    sent = rows.sparkSession.sparkContext.broadcast(_common(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_copies")
        common, seen = sent.value, set()
        for batch in batches:
            out = []
            for t, fp in zip(utf8(batch.column("t")), batch.column("fp").to_pylist(), strict=True):
                if fp in seen or not len(s := shingle_set(t, words)):
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                first = np.concatenate([s[~late], s[late]])[: len(s) - _least(len(s), similarity) + 1]
                full = np.ones(len(first), np.int64)
                out.append((first.view(np.int64), full * fp, full * len(s), np.arange(len(first))))
            if out:
                yield _batch([np.concatenate(c) for c in zip(*out, strict=True)], ["h", "fp", "n", "pos"])

    return rows.mapInArrow(run, _ROW)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows sorted by their first column -> columns and the edges of whole buckets in them."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cols[0]) != 0) + 1])
        held = [c[edges[-1] :] for c in cols]
        if len(edges) > 1:
            yield [c[: edges[-1]] for c in cols], edges
    if held is not None and len(held[0]):
        yield held, np.array([0, len(held[0])])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h and fp -> those of buckets with two sets or more, each set once, with a digest of the bucket's sets."""
    for cols, _ in _buckets(batches):
        new = np.ones(len(cols[0]), bool)
        new[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)
        cols = [c[new] for c in cols]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(cols[0]) != 0]))
        sizes = np.diff(np.append(edges, len(cols[0])))
        bucket, size = np.repeat(np.add.reduceat(cols[1], edges), sizes), np.repeat(sizes, sizes)
        many = size > 1
        yield _batch([c[many] for c in (bucket, size, *cols)], ["bucket", "size", "h", "fp", "n", "pos"])


#: What a set carries within a bucket.
_MEMBER = ["bucket", "fp", "row", "n", "pos", *PRINT]
#: The first buckets of a set, as far as they come before the row's own; 0 for none.
FIRST = ["b1", "b2", "b3", "b4"]


def _apart(a: dict, b: dict, similarity: float) -> np.ndarray:
    """Whether sizes and positions exclude pairs of one bucket."""
    both = np.minimum(a["pos"], b["pos"]) + np.minimum(a["n"] - a["pos"], b["n"] - b["pos"])
    return both * (1 + similarity) < similarity * (a["n"] + b["n"]) - 1e-6


def _bits(a: dict, b: dict, names: list[str]) -> np.ndarray:
    return sum(np.bitwise_count(a[s] ^ b[s]).astype(np.int64) for s in names)


def _near(a: dict, b: dict, similarity: float) -> np.ndarray:
    """Whether neither parities nor fingerprints exclude pairs."""
    return (_bits(a, b, PRINT[:2]) <= FAR) & (_bits(a, b, PRINT[2:]) * (1 + similarity) <= (1 - similarity) * (a["n"] + b["n"]) + 1e-6)


def _pick(rows: dict, at) -> dict:
    return {k: v[at] for k, v in rows.items()}


def _across(similarity: float):
    """Members with their root, sorted by bucket -> pairs of different roots that may have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, edges in _buckets(batches):
            rows = {k: c.view(np.uint64) if k in PRINT else c for k, c in zip([*_MEMBER, *FIRST, "root"], cols, strict=True)}
            starts, ends = edges[:-1], edges[1:]
            mixed = np.minimum.reduceat(rows["root"], starts) != np.maximum.reduceat(rows["root"], starts)
            for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
                every = _pick(rows, slice(a, b))
                for first in range(0, b - a, 256):
                    some = {k: every[k][first : first + 256, None] for k in ("fp", "n", "pos", "root")}
                    i, j = np.nonzero((some["root"] != every["root"]) & (some["fp"] < every["fp"]) & ~_apart(some, every, similarity))
                    x, y = _pick(every, first + i), _pick(every, j)
                    ok = _near(x, y, similarity)
                    for mine in FIRST:
                        for theirs in FIRST:
                            ok &= (x[mine] != y[theirs]) | (x[mine] == 0)
                    if ok.any():
                        yield _batch([x["fp"][ok], x["row"][ok], y["fp"][ok], y["row"][ok]], ["u", "ur", "v", "vr"])

    return run


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, row, fingerprint) sorted by cell and fp -> (u, ur, v, vr, bits that differ, 1 if v is the later one): for each
    set the nearest before and behind it, over the cell's signatures, if within REACH."""
    none = np.iinfo(np.int64).max
    for cols, _ in _buckets(batches):
        cell, fp, row, words = *cols[:3], np.stack(cols[3:]).view(np.uint64)
        n = len(cell)
        byte = (cell >> 8) ^ 1
        other = ((words[byte >> 3, np.arange(n)] >> (8 * (byte & 7)).astype(np.uint64)) & np.uint64(255)).astype(np.int64)
        found = np.full((2, n), none)
        for wild in range(8):
            key = (cell << 8) | (other & ~(1 << wild))
            order = np.argsort(key, kind="stable")
            key, at = key[order], np.arange(n)
            for step in range(1, min(WINDOW, n - 1) + 1):
                at = at[at < n - step]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                a, b = order[at], order[at + step]
                far = np.bitwise_count(words[:, a] ^ words[:, b]).sum(axis=0, dtype=np.int64)
                near = far <= REACH
                a, b, far = a[near], b[near], far[near]
                found[1, a] = np.minimum(found[1, a], far << 40 | b)
                found[0, b] = np.minimum(found[0, b], far << 40 | a)
        for side in (0, 1):
            u = np.flatnonzero(found[side] != none)
            v = found[side, u] & ((1 << 40) - 1)
            yield _batch([fp[u], row[u], fp[v], row[v], found[side, u] >> 40, np.full(len(u), side)], ["u", "ur", "v", "vr", "far", "side"])


def by_signatures(nodes: DataFrame) -> DataFrame:
    """Written sets ``(fp, row, s0, s1, s10, s11)`` -> pairs ``(u, ur, v, vr)`` of each set with the nearest sets that a signature gives,
    one of smaller and one of larger node."""
    # a segment that differs by one bit at most has an equal byte: sets are dealt by each of their 32 bytes, and the
    # variants of the segment's other byte are made where they meet
    cells = ", ".join(f"{256 * (8 * w + k)}L + (shiftrightunsigned({c}, {8 * k}) & 255L)" for w, c in enumerate(FINGERPRINT) for k in range(8))
    rows = nodes.selectExpr(f"explode(array({cells})) AS cell", "fp", "row", *FINGERPRINT)
    found = rows.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_nearest, "u long, ur long, v long, vr long, far long, side long")
    return found.groupBy("u", "ur", "side").agg(F.min(F.struct("far", "v", "vr")).alias("m")).select("u", "ur", "m.v", "m.vr")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``(u, ur, v, vr)``, sets and the rows of their texts, with the similarity, written; texts: (row, t)."""
    # written, so that its size is known when it meets the texts: if it is small it is sent, and no text moves
    near, near_path = written(pairs.distinct(), "near-pairs")
    ends = near.selectExpr("u", "v", "inline(array(struct(ur AS row), struct(vr AS row)))")
    dealt = ends.join(texts, "row").select("u", "v", "t").repartition("u", "v").sortWithinPartitions("u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_copies")
        held: tuple | None = None
        for batch in batches:
            out = []
            for u, v, t in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), utf8(batch.column("t")), strict=True):
                if held is None:
                    held = (u, v, t)
                    continue
                a, b = shingle_set(held[2], words), shingle_set(t, words)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                    out.append((u, v))
                held = None
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    found = written(dealt.mapInArrow(run, "u long, v long"), "near-links")[0]
    forget(pairs.sparkSession, near_path)
    return found


def links(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Written texts ``(t, fp, s0 to s11, row)``, with their nodes, numbers and a number of the row -> links ``(u, v)``
    with the components of all pairs of that similarity."""
    spark = rows.sparkSession
    dealt = _prefixes(rows, words, similarity).repartition("h").sortWithinPartitions("h", "fp")
    shared, shared_path = written(dealt.mapInArrow(_shared, f"bucket long, size long, {_ROW}"), "near-shared")
    once = shared.groupBy("bucket", "fp").agg(F.min(F.struct("h", "pos", "n", "size")).alias("m")).select("bucket", "fp", "m.pos", "m.n", "m.size")
    nodes, nodes_path = written(rows.groupBy("fp").agg(F.min("row").alias("row"), *(F.min(s).alias(s) for s in NUMBERS)), "near-nodes")
    before = Window.partitionBy("fp").orderBy(F.desc("size"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = [F.coalesce(F.nth_value("bucket", i + 1).over(before), F.lit(0)).alias(b) for i, b in enumerate(FIRST)]
    members = written(once.join(nodes, "fp").select(*_MEMBER, *firsts), "near-members")[0]
    forget(spark, shared_path)
    texts = rows.select("row", "t")

    near = _verified(by_signatures(nodes).selectExpr("inline(array(IF(u < v, struct(u, ur, v, vr), struct(v AS u, vr AS ur, u AS v, ur AS vr))))"), texts, words, similarity)
    forget(spark, nodes_path)
    rooted = members.join(components(near).withColumnRenamed("node", "fp"), "fp", "left").select(*_MEMBER, *FIRST, F.coalesce("root", "fp").alias("root"))
    rest = rooted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_across(similarity), "u long, ur long, v long, vr long")
    return near.unionByName(_verified(rest, texts, words, similarity))


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of texts of that similarity: the one with the smallest key.

    All columns stay. Cases: null and wordless texts have the empty set and are copies of each other; a text
    with fewer words than a shingle is one shingle; of a component with null keys only, one row stays; of
    repeated rows one stays, and rows that share a key but no component all count; an empty table gives an empty result.
    """
    fp = "__ls_fp"
    # written with their texts: nodes are made once
    marked = written(with_nodes(docs, words, text_col, fp).withColumn("__ls_row", F.monotonically_increasing_id()), "nodes")[0]
    prints = marked.select(F.col(id_col).alias("k"), F.col(fp).alias("fp"))
    rows = marked.select(F.col(text_col).cast("string").alias("t"), F.col(fp).alias("fp"), *(F.col(f"{fp}{i}").alias(s) for i, s in enumerate(NUMBERS)), F.col("__ls_row").alias("row"))
    roots = components(links(rows, words, similarity))
    found = prints.select("fp").distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("component_id"))
    return first_rows(docs, marked, prints, found, id_col, fp)
