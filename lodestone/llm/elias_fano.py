"""Token-id output: documents as one id array per segment, with Elias-Fano coded boundaries.

Segment format (little-endian)::

    header   : magic 8s, version u32, id width u8, n_docs u64, n_ids u64, null_keys u64, first_key i64
    bounds   : Elias-Fano of the n_docs + 1 boundaries (0 first, n_ids last)
    keys     : Elias-Fano of the non-null document keys less first_key (ascending)
    ids      : n_ids unsigned integers of the id width (2 or 4 bytes)

An Elias-Fano block keeps ``low`` bits of every value packed and the rest in unary, about
2 + log2(universe / n) bits a value, and one sample for every ``SAMPLE`` set bits so that ``select``
starts near its answer. Offsets thus come from ``select`` with no table of 64-bit offsets.

Segments are cut by id count inside ranges of the key, so ids lie in ascending key order over
(part, segment). They are stored as rows of a Parquet table, which reaches any store that Spark does;
``export`` writes one as a plain file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import claim, remembers, texts, written

MAGIC = b"LDSTSEG1"
HEAD = struct.Struct("<8sIB3xQQQq")
EF_HEAD = struct.Struct("<QQBQQQ")
#: One select sample for so many set bits.
SAMPLE = 256
#: A segment is closed once it has so many ids.
SEGMENT_IDS = 4_000_000
#: Documents whose boundaries and keys are unpacked at once.
SLICE = 4096
#: Distinct chunks whose ids a worker remembers; then it begins anew. Longer chunks are not remembered, which bounds the bytes.
REMEMBERED, LONGEST = 700_000, 64
#: Pre-tokens of byte-level BPE (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space but for the space and the line feed (fixed values).
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_CHUNKS = re.compile(r"\s*\S+|\s+").findall


class EliasFano:
    """A non-decreasing sequence of unsigned integers with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        if n and low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32 if n == 0 or at[-1] < 2**32 else np.uint64))

    def to_bytes(self) -> bytes:
        head = EF_HEAD.pack(self.n, self.samples.itemsize, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        n, width, low_bits, a, b, c = EF_HEAD.unpack_from(data)
        at = EF_HEAD.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, f"<u{width}", c, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + c * width

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        i, j = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[i // 8 : (j + 7) // 8], bitorder="little")[i % 8 : i % 8 + j - i]
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Value i, reading from the nearest sample on."""
        return int(self.between(i, i + 1)[0])

    def between(self, first: int, end: int) -> np.ndarray:
        """Values first to end - 1, reading from the nearest sample on."""
        if not 0 <= first < end <= self.n:
            raise IndexError(first, end)
        at, passed = int(self.samples[first // SAMPLE]), first % SAMPLE
        byte, wanted = at // 8, passed + end - first
        span = 64 + wanted // 4
        while len(ones := np.flatnonzero(np.unpackbits(self.high[byte : byte + span], bitorder="little")[at % 8 :])) < wanted:
            span *= 2
        high = (ones[passed:wanted] + at - np.arange(first, end)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(first, end)

    def all(self) -> np.ndarray:
        """Every value, as unsigned 64-bit integers."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        return ((at - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)) | self._lows(0, self.n)


class Segment:
    """Documents of one segment: ``starts`` (boundaries), ``keys`` (None for null) and ``ids``."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, width, self.n_docs, self.n_ids, self.null_keys, self.first_key = HEAD.unpack_from(view)
        if magic != MAGIC or version != 1:
            raise ValueError("not a segment of this format")
        at = HEAD.size
        self.bounds, used = EliasFano.from_bytes(view[at:])
        at += used
        self.key_set, used = EliasFano.from_bytes(view[at:])
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at + used)

    @staticmethod
    def pack(keys: list[int | None], docs: list[np.ndarray]) -> bytes:
        known = [k for k in keys if k is not None]
        first = known[0] if known else 0
        sizes = np.fromiter(map(len, docs), np.uint64, len(docs))
        ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
        bounds = EliasFano.encode(np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)]))
        offsets = EliasFano.encode(np.fromiter((k - first for k in known), np.uint64, len(known)))
        head = HEAD.pack(MAGIC, 1, width, len(keys), len(ids), len(keys) - len(known), first)
        return b"".join((head, bounds.to_bytes(), offsets.to_bytes(), ids.astype(f"<u{width}").tobytes()))

    def keys(self, first: int, end: int) -> list[int | None]:
        """Keys of documents first to end - 1; nulls come first."""
        none = self.null_keys
        known = self.key_set.between(max(first - none, 0), end - none).tolist() if end > max(first, none) else []
        return [None] * (end - first - len(known)) + [self.first_key + x for x in known]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the chunks it has seen.

    A chunk runs from a space (or line feed) that follows a non-space up to the next one. Byte-level BPE
    always starts a pre-token there, so the ids of a text are those of its chunks. A new chunk is cut into
    pre-tokens, and the library's model turns each into ids. Where white space is of other kinds or in runs,
    a chunk is a run of it and what follows. Texts with the text of an added token go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        made = json.loads(self.library.to_str())
        pre = made.get("pre_tokenizer") or {}
        #: Chunks are exact for plain byte-level pre-tokenization only.
        self.plain = made["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made.get("normalizer")
        added = [x["content"] for x in made.get("added_tokens") or []]
        self.whole = [*OTHER_SPACE, *added]
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *added]  # white space here, but not in the pre-tokenizer
        self.cut = regex.compile(BYTE_LEVEL).findall
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # characters that hold every byte of UTF-8: below 2048, and one for each lead byte from E0 on
        held = [chr(c) for c in range(2048)] + [chr(c) for c in (0x800, *range(0x1000, 0xD000, 0x1000), 0xD000, 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000)]
        pairs = zip("".join(held).encode(), letters.pre_tokenize_str("".join(held))[0][0], strict=True)
        self.bytes = dict(pairs)
        if self.plain:
            self.model._resize_cache(0)  # what it remembers lies here already
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, items: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, self.dtype).tobytes() for x in self.library.encode_batch_fast(items, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            mapped = piece.encode().decode("latin-1").translate(self.bytes)
            got = array(self.code, [x.id for x in self.model.tokenize(mapped)]).tobytes()
            if len(piece) <= LONGEST:
                self.pieces[piece] = got
        return got

    def _chunk(self, part: str) -> bytes:
        if part.startswith("   "):  # a chunk as it stands
            return b"".join(map(self._piece, self.cut(part[3:])))
        if part[0] == "\n":
            return self._piece("\n") + b"".join(map(self._piece, self.cut(part[1:])))
        text = part[2:] if part[0] == " " else f" {part}"
        if part.isascii():
            if part.isalpha():
                return self._piece(text)
            if part[:-1].isalpha():  # and one other character, which isn't white space
                return self._piece(text[:-1]) + self._piece(text[-1])
        return b"".join(map(self._piece, self.cut(text)))

    def _joined(self, parts: list[str]) -> bytes:
        known = self.known
        new = set(parts).difference(known)
        for p in new:
            known[p] = self._chunk(p)
        out = b"".join(map(known.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        for t in batch:
            if self.plain and not any(w in t for w in self.whole):
                parts = t.replace("\n", " \n").split(" ")
                if "" not in parts and "\n" not in parts:
                    parts[0] = f"  {parts[0]}"  # no space before it
                    out.append(self._joined(parts))
                    continue
            if self.plain and not any(w in t for w in self.odd):
                # white space of any kind and number: a chunk is a run of it and what follows
                parts = [f"   {p}" for p in _CHUNKS(t)]
                out.append(self._joined(parts))
                continue
            out.append(None)
        rest = iter(self._library([t for t, got in zip(batch, out, strict=True) if got is None]))
        return [next(rest) if got is None else got for got in out]


_encoders: dict[str, Encoder] = {}
remembers("elias_fano", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text, end it with ``end_id`` and write segments in ascending key order.

    Returns the written table: part, segment, n_docs, n_ids, data. Texts are range-partitioned by key
    (and checksum, and row, so that rows of one key spread) before they are encoded.

    Cases: null text is empty; null keys come first; repeated keys stay as separate documents; an empty
    table gives no segment; a document longer than a segment has one of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.withColumns({"crc": F.crc32(F.col("text").cast("binary")), "row": F.monotonically_increasing_id()}).repartitionByRange(n, F.col("k").asc_nulls_first(), "crc", "row").sortWithinPartitions(F.col("k").asc_nulls_first(), "crc", "row")
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("elias_fano")
        enc, keys, held, ids, made = encoder(tokenizer), [], [], 0, 0
        wide = np.dtype("<u2") if end_id < 65536 and enc.dtype.itemsize == 2 else np.dtype("<u4")
        end = np.asarray([end_id], wide)
        part = -1

        def close() -> pa.RecordBatch:
            data = Segment.pack(keys, held)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([part], [made], [len(keys)], [ids], [data]), schema, strict=True)], schema=schema)

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for k, got in zip(some.column("k").to_pylist(), enc.encode(texts(some.column("text"))), strict=True):
                    keys.append(k)
                    held.append(np.concatenate([np.frombuffer(got, enc.dtype).astype(wide, copy=False), end]))
                    ids += len(held[-1])
                    if ids >= segment_ids:
                        yield close()
                        keys, held, ids, made = [], [], 0, made + 1
        if keys:
            yield close()

    packed = dealt.select(F.spark_partition_id().alias("part"), "k", "text").mapInArrow(encode, "part int, segment int, n_docs long, n_ids long, data binary")
    return written(packed, "segments")[0]


def read_segments(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of written segments: key, start, n_tokens and the crc32 of the ids as unsigned 32-bit integers.

    ``start`` counts the ids of all documents before, over all segments. Ids before a part come from
    per-part totals (as many rows as parts), those before a segment from the segments of its part.
    """
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner")).join(parts, "part")
    placed = segments.join(bases.select("part", "segment", (F.col("ahead") + F.col("inner")).alias("base")), ["part", "segment"])
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base"), batch.column("data"), strict=True):
                seg = Segment(data.as_buffer())
                for first in range(0, seg.n_docs, SLICE):
                    end = min(first + SLICE, seg.n_docs)
                    at = seg.bounds.between(first, end + 1).astype(np.int64)
                    ids = memoryview(seg.ids[at[0] : at[-1]].astype("<u4")).cast("B")
                    crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in pairwise((at - at[0]).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(seg.keys(first, end), pa.int64()), pa.array(base.as_py() + at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], schema=pa.schema(fields))

    out = placed.select("base", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("doc_id", id_col)


def export(data: bytes, path: str) -> None:
    """One segment as a plain file on a shared mount."""
    with open(path, "wb") as out:
        out.write(data)
