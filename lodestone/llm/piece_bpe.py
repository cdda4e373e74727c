"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text there is one last token. It is the token t ending there (an automaton gives
all of them) such that the last token of the prefix before t and t are compatible: merging the text of
the two again leaves the border between them standing. The table keeps that token per prefix; ids are
then read off from the end backwards.

Merging never crosses a place where no piece can lie across: before a space that follows a non-space,
around a character that is no piece (such as a line feed), and between two characters that are
neighbours in no piece. Texts are cut there, and a worker remembers the ids of the cuts it has seen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import claim, remembers, texts

SPACE = "▁"
#: Distinct cuts whose ids a worker remembers; then it begins anew. Longer cuts are not remembered, which bounds the bytes.
REMEMBERED, LONGEST = 400_000, 64
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]*")


class PieceBpe:
    """Encoder and decoder of one model of BPE kind, identity normalization and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        if len(self.byte_id) != 256 or lib.normalize("Å Ａ ") != f"{SPACE}Å{SPACE}Ａ{SPACE}" or any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("only BPE models with byte fallback, identity normalization and leading spaces are supported")
        self.id = {self.pieces[i]: i for i in plain}
        #: Merge order: 0 merges first. Single characters are there from the start.
        order = sorted((-lib.get_score(self.id[p]), self.id[p], p) for p in self.id if len(p) > 1)
        self.rank = {p: k for k, (_, _, p) in enumerate(order)}
        self.halves: dict[str, tuple[str, str]] = {}
        # only tokens that stay whole when their own text is encoded can be last tokens
        self.tokens = [p for p in self.id if self._whole(p)]
        self.automaton = ahocorasick.Automaton()
        for p in self.tokens:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.single = {p for p in self.tokens if len(p) == 1}
        self.decimal = {p: f",{self.id[p]}" for p in self.tokens}
        self.neighbours = {p[i : i + 2] for p in self.tokens for i in range(len(p) - 1)}
        if not self.single.issuperset("".join(self.neighbours)):
            raise ValueError("every character of a longer piece must be a piece")
        self.fits: dict[tuple[str, str], bool] = {}
        self.by_text = {str(i): p.replace(SPACE, " ") for i, p in enumerate(self.pieces)} | {str(i): f"\0{b:02x}" for b, i in self.byte_id.items()}
        self.by_text |= {str(i): "" for i in range(n) if lib.is_control(i)}
        self.known: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def _whole(self, piece: str) -> bool:
        """Merge a piece's characters, best first and leftmost among equals; note its two last halves."""
        parts = list(piece)
        while len(parts) > 1:
            found = [(self.rank[m], i) for i, m in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if m in self.rank]
            if not found:
                return False
            i = min(found)[1]
            if len(parts) == 2:
                self.halves[piece] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether the border between two tokens stands when their text is merged anew.

        The merges on both sides are taken back, the latest first. In each state the two tokens at the
        border would join if their union merges before either grows further (on equal rank: before the
        right one, after the left one).
        """
        (left, right), rank, halves = pair, self.rank, self.halves
        left_next = right_next = len(rank)
        while True:
            joint = rank.get(left + right)
            if joint is not None and joint < left_next and joint <= right_next:
                self.fits[pair] = False
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                left_next, left = a, halves[left][1]
            elif b >= 0:
                right_next, right = b, halves[right][0]
            else:
                self.fits[pair] = True
                return True

    def _run(self, text: str) -> str:
        """Ids of characters that are all pieces."""
        fits, last = self.fits, [""] * (len(text) + 1)
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if not last[end]:
                if size == end:
                    last[end] = token
                elif before := last[end - size]:
                    pair = (before, token)
                    ok = fits.get(pair)
                    if ok if ok is not None else self._compatible(pair):
                        last[end] = token
        out, at = [], len(text)
        while at:
            out.append(self.decimal[last[at]])
            at -= len(last[at])
        return "".join(out[::-1])

    def _word(self, text: str) -> str:
        """Ids, as decimals each after a comma, of a text with no place inside where no piece lies."""
        got = self.words.get(text)
        if got is None:
            ok = text in self.single if len(text) == 1 else True  # one alone may be no piece
            got = self._run(text) if ok else "".join([f",{self.byte_id[b]}" for b in text.encode()])
            if len(text) <= LONGEST:
                self.words[text] = got
        return got

    def _cut(self, text: str) -> str:
        """As ``_word`` of any text: it is cut between neighbours that are neighbours in no piece."""
        near = self.neighbours
        at = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in near]
        if not at:
            return self._word(text)
        return "".join([self._word(text[a:b]) for a, b in zip([0, *at], [*at, len(text)], strict=True)])

    def cuts(self, text: str) -> list[str]:
        """The ids of a whole text, cut by cut: each as decimals with a comma before."""
        if not text:
            return []
        if len(self.known) > REMEMBERED:
            self.known, self.decoded = {}, {}
        if len(self.words) > REMEMBERED:
            self.words = {}
        if len(self.fits) > REMEMBERED:
            self.fits = {}
        known = self.known
        if SPACE not in text:
            parts = text.replace("\n", " \n").split(" ")
            if "" not in parts:  # no run of spaces, none at an end or before a line feed
                new = set(parts).difference(known)
                for p in new:
                    known[p] = self._cut(p if p[0] == "\n" else SPACE + p)
                cuts = list(map(known.__getitem__, parts))
                for p in new:
                    if len(p) > LONGEST:
                        del known[p]
                return cuts
        return list(map(self._cut, _RUNS.findall(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str) -> str:
        """The ids of a whole text as decimals joined by commas."""
        return "".join(self.cuts(text))[1:]

    def _text(self, ids: str) -> str:
        out = "".join(map(self.by_text.__getitem__, ids.split(",")[1:]))
        if "\0" in out:
            out = _BYTES.sub(lambda m: bytes.fromhex(m[0].replace("\0", "")).decode("utf-8", "replace"), out)
        return out

    def decode(self, cuts: list[str]) -> str:
        """The text of ids given cut by cut, as ``cuts`` does; bytes of a character lie in one cut."""
        decoded = self.decoded
        new = set(cuts).difference(decoded)
        for ids in new:
            decoded[ids] = self._text(ids)
        out = "".join(map(decoded.__getitem__, cuts))
        for ids in new:
            if len(ids) > 6 * LONGEST:
                del decoded[ids]
        return out[1:] if out[:1] == " " else out


_BYTES = re.compile("(?:\0[0-9a-f]{2})+")
_models: dict[str, PieceBpe] = {}
remembers("piece_bpe", _models.clear)


def model(path: str) -> PieceBpe:
    """One per worker process."""
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, decode the ids again: key, ids (array), decoded text.

    Cases: null and empty texts have no ids and decode to the empty string; texts of any length are
    encoded whole; repeated rows and keys stay; other columns are ignored.
    """
    fields = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("piece_bpe")
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                cuts = [m.cuts(t) for t in texts(some.column("text"))]
                got = ["".join(c)[1:] for c in cuts]
                yield pa.RecordBatch.from_arrays([some.column("k"), pa.array([[int(i) for i in g.split(",")] if g else [] for g in got], pa.list_(pa.int32())), pa.array([m.decode(c) for c in cuts], pa.string())], schema=fields)

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "k long, ids array<int>, decoded string").withColumnRenamed("k", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``tokenize``, with each row's ids and text reduced to a count and two SHA-256 digests.

    Returns key, n_tokens, ids_sha256, decoded_sha256; cases as there.
    """
    fields = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("piece_bpe")
        m, sha = model(path), hashlib.sha256
        for batch in batches:
            counts, a, b = [], [], []
            for t in texts(batch.column("text")):
                cuts = m.cuts(t)
                ids = "".join(cuts)[1:]
                counts.append(ids.count(",") + 1 if ids else 0)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha(m.decode(cuts).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=fields)

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "k long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", id_col)
