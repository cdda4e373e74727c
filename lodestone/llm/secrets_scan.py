"""Secret scans: fixed base patterns, and novelty against a primed zstandard dictionary.

The base kinds (assign, access, hex) are patterns. The method adds kind ``novel``: a candidate is a
string of 16 or more key characters, of any kind, with a sensitive word near it on either side, on its line or
another, or right after a reported one (so that all lines of a key block count). Its novelty is what it adds to a compressed frame that is primed with common identifiers and with
the text around the candidate: compressed size with it less the size without, in bytes per character.
Ordinary identifiers and text repeated nearby cost little; random strings cost what their alphabet
carries, so digits alone and hex digits alone are held to a lower threshold. Candidates at or over the threshold are reported unless base spans cover them wholly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import claim, texts, with_column

# The base patterns, the least length of what they find, and the words that open a context.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = ("auth", "bearer", "credential", "key", "pass", "private", "secret", "signature", "token")
IDENTIFIERS = b"""import export default function return const class public private static async await self this
null true false string number boolean object array index length value result response request config option
settings default_value get_value set_value user_name user_id session_id client_id client_secret access_token
refresh_token api_key secret_key private_key public_key password passwd credential authorization bearer signature
environment production development example placeholder changeme your_api_key_here your_token_here xxxxxxxxxxxxxxxx
the quick brown fox jumps over lazy dog from with this that have name data file path list item order page test
session account service server client message number address account manager handler controller version update
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 ffffffff http://www.example.com/index.html
https://localhost:8080/api/v1/users application/json content-type text/html utf-8 sha256 base64 """
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.ASCII | re.IGNORECASE)
_HEXES = re.compile("[0-9a-f]+|[0-9A-F]+")
#: Characters on each side of a candidate in which a sensitive word counts, and that prime the frame.
REACH, AROUND = 128, 512
#: Bytes a character from which a candidate is novel: so few of its characters are found nearby or in words.
NOVELTY = 0.8


def base_spans(text: str, lower: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start and then by kind."""
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _marginal(candidate: str, around: str) -> float:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False).compress
    lead = around[:64].encode()
    return (len(squeeze(lead + candidate.encode())) - len(squeeze(lead))) / len(candidate)


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of the candidate, per character, given the text around it.

    The lesser of the candidate as it stands and lower-cased, so that words in camel case match too.
    """
    as_is = _marginal(candidate, around)
    return min(as_is, _marginal(candidate.lower(), around.lower())) if as_is >= NOVELTY else as_is


def _share(candidate: str) -> float:
    """Bits a character of the candidate's alphabet, as a share of the 6 of all key characters."""
    if candidate.isdigit():
        return math.log2(10) / 6
    return 4 / 6 if _HEXES.fullmatch(candidate) else 1.0


def _covered(a: int, b: int, base: list[tuple[int, str, int]]) -> bool:
    """Whether base spans, which are ordered, hold every character from a to b."""
    for s, _, e in base:
        if s > a:
            break
        a = max(a, e)
    return a >= b


def novel_spans(text: str, lower: str, base: list[tuple[int, str, int]], least: float = NOVELTY) -> list[tuple[int, str, int]]:
    """Spans of novel candidates that base spans do not cover wholly."""
    if not any(w in lower for w in CONTEXT_WORDS):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        c = m[0]
        a, b = m.span()
        if _covered(a, b, base):
            continue
        goes_on = out and not text[out[-1][2] : a].strip(" \t\r\n\"',\\")
        if not (goes_on or _CONTEXT.search(text[max(0, a - REACH) : a]) or _CONTEXT.search(text[b : b + REACH])):
            continue
        if novelty(c, text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND]) >= least * _share(c):
            out.append((a, "novel", b))
    return out


def spans_of(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and all spans, of a whole text."""
    lower = text.lower()
    base = base_spans(text, lower)
    return base, _ordered(base + novel_spans(text, lower, base))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's spans: key, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Positions count code points, ends are exclusive. Cases: null and empty texts have no span; texts of
    any length are scanned whole; repeated rows stay; other columns are ignored.
    """
    fields = pa.schema([("k", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_novel", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        for batch in batches:
            rows = []
            for t in texts(batch.column("t")):
                base, every = spans_of(t)
                kinds = [k for _, k, _ in every]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:], strict=True))], schema=fields)

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string").withColumnRenamed("k", id_col)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones as one) replaced by a mark."""
    out, at = [], 0
    for a, _, b in spans_of(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets in the text replaced; all rows and columns stay, ``count_col`` is its length.

    Null texts stay null, with a null count left as it was.
    """
    count = count_col if count_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        for batch in batches:
            new = [None if t is None else redacted(t) for t in batch.column(text_col).to_pylist()]
            held = batch.column(text_col)
            out = with_column(batch, text_col, pa.array(new, held.type))
            if count:
                was = batch.column(count)
                out = with_column(out, count, pa.array([w if t is None else len(t) for t, w in zip(new, was.to_pylist(), strict=True)], was.type))
            yield out

    return docs.mapInArrow(run, docs.schema)
