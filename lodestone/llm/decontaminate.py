"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every item has a fingerprint of its word shingles. A document's windows of an item's size get one each,
from running sums, so a window costs as much as a shingle. Item fingerprints are indexed by blocks: the
BITS bits are cut into blocks, and each block value maps to the items whose own value lies within
radius // blocks bits, so every item within the radius of a window is found in some block (pigeonhole).
Found pairs are then decided by the weighted Jaccard similarity of their shingle multisets (the weight of
a shingle is its count), which is computed exactly. A document shorter than an item is one window.

The second, third, ... equal shingle of a window has bits of its own in the fingerprint. The weighted
similarity is then that of plain sets, and similarity t means a cosine of 2 t / (1 + t) or more, whatever
repeats and whatever the two sizes are.

A window that similarity t or more joins to an item shares that part of its shingles with it. Fingerprints
are therefore made only for windows in which that many shingles occur in the benchmark, which loses
nothing.

The benchmark is taken in blocks of bounded bytes; each is sent to the executors and all documents pass
it, once for each block: the index of a block takes about 150 times its bytes in each worker. Documents are
never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import claim, remembers, texts

BITS, BLOCKS = 256, 16
#: Similarity 0.8 is an angle of about 27 degrees, 39 bits of 256 on average with a deviation of 6.
RADIUS = 63
#: Bytes of item text that are broadcast at once.
BLOCK_BYTES = 1_000_000
_WORDS = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORDS.findall(text.lower())


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words (of all, if there are fewer)."""
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        out = out * _P + h[i : i + len(out)]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _planes(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's BITS signs as +1 and -1."""
    made = np.empty((len(shingles), BITS // 64), np.uint64)
    for i in range(BITS // 64):
        x = shingles + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        made[:, i] = x ^ (x >> np.uint64(31))
    bits = np.unpackbits(made.view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _nth(shingles: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What stands for shingles that have j equal ones before them in their window."""
    return shingles + j.astype(np.uint64) * _P


def _sums(shingles: np.ndarray, width: int) -> np.ndarray:
    """Summed signs of every window of that width, equal shingles of a window told apart by ``_nth``.

    Moving a window on takes out the last of the shingles equal to its first one, and puts in one more equal to the new one.
    """
    n = len(shingles)
    code = np.unique(shingles, return_inverse=True)[1]
    places = np.sort(code * n + np.arange(n))

    def between(at: np.ndarray, first: np.ndarray | int, end: np.ndarray) -> np.ndarray:
        return np.searchsorted(places, code[at] * n + end) - np.searchsorted(places, code[at] * n + first)

    head, t = np.arange(width), np.arange(n - width)
    sums = np.empty((n - width + 1, BITS), np.int32)
    sums[0] = _planes(_nth(shingles[:width], between(head, 0, head))).sum(axis=0, dtype=np.int32)
    sums[1:] = _planes(_nth(shingles[width:], between(t + width, t + 1, t + width))) - _planes(_nth(shingles[: n - width], between(t, t, t + width) - 1))
    return np.cumsum(sums, axis=0, dtype=np.int32, out=sums)


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint16)


class Index:
    """Items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], n: int, radius: int = RADIUS):
        self.n, self.radius = n, radius
        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.shingles = [_shingles(_hashes(w), n) for _, w in self.items]
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.known = np.unique(np.concatenate(self.shingles)) if self.items else np.zeros(0, np.uint64)
        #: Of windows: (words, words in a shingle) -> items of that size.
        self.sizes: dict[tuple[int, int], np.ndarray] = {}
        by_size = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            by_size[len(w), min(n, len(w))].append(k)
        self.sizes = {size: np.array(ks) for size, ks in by_size.items()}
        self.prints = _packed(np.stack([_sums(s, len(s))[0] for s in self.shingles])) if self.items else np.zeros((0, BLOCKS), np.uint16)
        # short items: shingles of fewer words than n
        self.short = sorted({m for _, m in self.sizes if m < n})
        #: Hashes of the words of the benchmark; any other word counts as 0 while shingles are looked for.
        self.word_hash = {x: xxhash.xxh64_intdigest(x) for _, w in self.items for x in w}
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.known >> np.uint64(46)] = True
        # for each block and value: the items whose own value lies within the block's share of the radius
        share = np.array([v for v in range(1 << 16) if v.bit_count() <= radius // BLOCKS], np.uint16)
        self.index = []
        for block in range(BLOCKS if self.items else 0):
            near = (self.prints[:, block, None] ^ share[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            self.index.append((np.searchsorted(near[order], np.arange(65537)), (order // len(share)).astype(np.int32)))
        self.size_of = np.zeros(len(self.items), np.int64)
        for number, ks in enumerate(self.sizes.values()):
            self.size_of[ks] = number

    def _similarity(self, item: int, window: np.ndarray) -> float:
        a, b = self.counts[item], Counter(window.tolist())
        both = sum(min(c, b[s]) for s, c in a.items() if s in b)
        return both / (sum(a.values()) + len(window) - both)

    def matches(self, text: str, least: float) -> dict[int, tuple[float, int, int]]:
        """Item position -> (similarity, Hamming distance, first word) of its best window."""
        words = words_of(text)
        codes = np.fromiter(map(self.word_hash.get, words, repeat(0)), np.uint64, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        for m in [self.n, *self.short]:
            if len(words) < m:
                continue
            found = _shingles(codes, m)
            hit = np.flatnonzero(self.maybe[found >> np.uint64(46)])
            some = found[hit]
            hit = hit[self.known[np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)] == some]
            if not len(hit):
                continue
            widths = self._widths(m, hit, len(found), least)
            longer = self._longer(m, hit, len(found), least)
            if not widths and not longer:
                continue
            shingles = _shingles(_hashes(words), m)
            if widths:
                self._windows(widths, shingles, hit, least, best)
            if longer:
                sizes = np.array(longer)
                self._decide(_packed(_sums(shingles, len(shingles))), np.array([0]), np.array([len(shingles)]), lambda _, k: np.isin(self.size_of[k], sizes), shingles, least, best)
        return best

    def _widths(self, m: int, hit: np.ndarray, n: int, least: float) -> dict[int, int]:
        """Sizes with shingles of m words -> shingles in a window, of those that enough hits may fill."""
        return {number: w for number, size in enumerate(self.sizes) if size[1] == m and (w := size[0] - m + 1) <= n and len(hit) >= least * w - 1e-9}

    def _longer(self, m: int, hit: np.ndarray, n: int, least: float) -> list[int]:
        """Sizes that n shingles of m words, a whole document, fall short of without being too few."""
        return [number for number, size in enumerate(self.sizes) if size[1] == m and (w := size[0] - m + 1) > n and len(hit) >= least * w - 1e-9]

    def _windows(self, widths: dict[int, int], shingles: np.ndarray, hit: np.ndarray, least: float, best: dict) -> None:
        """Look at the windows that cover one of ``hit``."""
        reach = max(widths.values()) - 1
        hits = np.zeros(len(shingles) + 1, np.int64)
        hits[hit + 1] = 1
        hits = np.cumsum(hits)
        low, high = np.maximum(hit - reach, 0), hit
        new = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
        for a, b in zip(low[np.concatenate([[0], new])].tolist(), high[np.concatenate([new - 1, [len(high) - 1]])].tolist(), strict=True):
            for at in range(a, b + 1, 512):
                self._stretch(widths, shingles, hits, at, min(b, at + 511), least, best)

    def _stretch(self, widths: dict[int, int], shingles: np.ndarray, hits: np.ndarray, first: int, last: int, least: float, best: dict) -> None:
        """Windows that start at first to last.

        A similarity of ``least`` takes common shingles for that share of a window, so windows with fewer
        of the benchmark's shingles are passed over.
        """
        some = {}
        for number, width in widths.items():
            at = np.arange(first, min(last + 1, len(shingles) - width + 1))
            if len(at := at[hits[at + width] - hits[at] >= least * width - 1e-9]):
                some[number] = at - first
        if not some:
            return
        part = shingles[first : last + max(widths[number] for number in some)]
        sums = None
        if len(np.unique(part)) == len(part):
            sums = np.zeros((len(part) + 1, BITS), np.int32)
            np.cumsum(_planes(part), axis=0, dtype=np.int32, out=sums[1:])
        prints, starts, sizes = [], [], []
        for number, at in some.items():
            width = widths[number]
            prints.append(_packed(_sums(part[: at[-1] + width], width)[at] if sums is None else sums[at + width] - sums[at]))
            starts.append(at + first)
            sizes.append(np.full(len(at), number))
        of = np.concatenate(sizes)
        self._decide(np.concatenate(prints), np.concatenate(starts), np.array([widths[number] for number in of.tolist()]), lambda w, k: of[w] == self.size_of[k], shingles, least, best)

    def _decide(self, prints: np.ndarray, starts: np.ndarray, widths: np.ndarray, fits: Callable, shingles: np.ndarray, least: float, best: dict) -> None:
        """Compare windows with the items within the radius that ``fits`` (window, item) lets through."""
        pairs = []
        for block, (ends, items) in enumerate(self.index):
            a, b = ends[prints[:, block]], ends[prints[:, block].astype(np.int64) + 1]
            w = np.repeat(np.arange(len(prints)), b - a)
            k = items[np.arange(len(w)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
            fit = fits(w, k)
            pairs.append(w[fit] * len(self.items) + k[fit])
        w, k = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
        far = np.bitwise_count(prints[w] ^ self.prints[k]).sum(axis=1)
        close = far <= self.radius
        for i, item, d in zip(w[close].tolist(), k[close].tolist(), far[close].tolist(), strict=True):
            at = int(starts[i])
            s = self._similarity(item, shingles[at : at + int(widths[i])])
            if s >= least and (item not in best or (-s, d, at) < (-best[item][0], *best[item][1:])):
                best[item] = (s, d, at)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number of bytes at a time."""
    held, size = [], 0
    for row in items.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1].encode()) + 500
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_indexes: dict[tuple, Index] = {}
remembers("decontaminate", _indexes.clear)


def _index(key: tuple, sent, n: int) -> Index:
    """One index per worker process and block."""
    claim("decontaminate")
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(sent.value, n)
    return _indexes[key]


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item that one of its windows matches.

    Returns key, item, similarity, hamming, first_word (of the best window, the first among equals).

    Cases: null or wordless texts match nothing; items with fewer words than a shingle are one shingle;
    repeated documents or items give a row each; a text shorter than an item is compared with it as a whole; no item or no document gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    fields = pa.schema([("k", pa.int64()), ("i", pa.int64()), ("similarity", pa.float64()), ("hamming", pa.int32()), ("first_word", pa.int64())])
    kinds = "k long, i long, similarity double, hamming int, first_word long"
    out = spark.createDataFrame([], kinds)
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col)):
        sent = spark.sparkContext.broadcast(block)
        key = (spark.sparkContext.applicationId, sent._jbroadcast.id(), number)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent, words)
            for batch in batches:
                found = [(k, index.items[i][0], *m) for k, t in zip(batch.column("k").to_pylist(), texts(batch.column("t")), strict=True) for i, m in sorted(index.matches(t, similarity).items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 5, fields, strict=True)], schema=fields)

        out = rows.mapInArrow(run, kinds) if number == 0 else out.unionByName(rows.mapInArrow(run, kinds))
    return out.withColumnsRenamed({"k": id_col, "i": item_col})


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that match an item; all columns stay, cases as in ``contamination``."""
    spark, out = docs.sparkSession, docs
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col)):
        sent = spark.sparkContext.broadcast(block)
        key = (spark.sparkContext.applicationId, sent._jbroadcast.id(), number)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent, words)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t, similarity) for t in texts(batch.column(text_col))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
