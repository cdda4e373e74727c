"""Pieces of a file on their way to chunks, and the header that goes before each."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from lodestone.config import Budget

# The context of the embedder, the margin below it, the least header, the cap of lists.
CONTEXT, MARGIN, LEAST_HEADER, MOST = 2048, 8, 70, 12


@dataclass(frozen=True)
class Piece:
    text: str
    first: int
    last: int
    symbol: str | None
    kind: str
    parents: tuple[str, ...] = ()
    exported: bool = False
    doc: str | None = None
    parent_doc: str | None = None


@dataclass(frozen=True)
class FileFacts:
    """What all chunks of a file share."""

    repo: str
    path: str
    imports: tuple[str, ...] = ()
    exports: tuple[str, ...] = ()
    module_doc: str | None = None
    callers: dict[str, list[str]] = field(default_factory=dict)


def tokens(text: str) -> int:
    return math.ceil(len(text) / 3.2)


def words_of_path(path: str) -> str:
    bare = re.sub(r"(?i)\.[a-z]+$", "", path)
    apart = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"[/\\._\-]+", " ", bare))
    return " ".join(w for w in apart.split() if len(w) > 1)


def _list(items: tuple[str, ...]) -> str:
    more = f" (+{len(items) - MOST})" if len(items) > MOST else ""
    return ", ".join(items[:MOST]) + more


def header(facts: FileFacts, p: Piece, budget: Budget) -> str:
    """The lines before a chunk's text; optional ones go, from the last, while it is too long."""
    lead = [f"// repo: {facts.repo}", f"// file: {facts.path}"]
    scope = [*p.parents, *([p.symbol] if p.symbol else [])]
    tail = ([f"// scope: {p.kind} {' > '.join(scope)}"] if scope else []) + ([f"// doc: {p.doc}"] if p.doc else [])
    called_by = facts.callers.get(p.symbol or "", []) if budget.callers else []
    optional = [
        line
        for wanted, line in (
            (called_by, f"// callers: {', '.join(called_by)}"),
            (budget.class_doc and p.parent_doc, f"// class-doc: {p.parent_doc}"),
            (budget.module_doc and facts.module_doc and facts.module_doc != p.doc, f"// module: {facts.module_doc}"),
            (budget.path_words, f"// path-words: {words_of_path(facts.path)}"),
            (budget.imports and facts.imports, f"// imports: {_list(facts.imports)}"),
            (budget.exports and facts.exports, f"// exports: {_list(facts.exports)}"),
        )
        if wanted
    ]
    room = min(budget.header_budget, max(tokens(p.text), LEAST_HEADER))
    n = next((n for n in range(len(optional), 0, -1) if tokens("\n".join([*lead, *optional[:n], *tail])) <= room), 0)
    text = "\n".join([*lead, *optional[:n], *tail])
    return text if tokens(text) <= budget.header_budget else text[: int(budget.header_budget * 3.2)]


def pack(lines: list[str], limit: int, only_at_blank: bool = False) -> list[tuple[int, int]]:
    """Half-open ranges of lines: closed before the line that exceeds the limit (or the next blank one)."""
    out, begun, spent = [], 0, 0
    for i, line in enumerate(lines):
        cost = tokens(line)
        if i > begun and spent + cost > limit and (not only_at_blank or not line.strip()):
            out.append((begun, i))
            begun, spent = i, 0
        spent += cost
    return [*out, (begun, len(lines))] if lines else out


def cut(p: Piece, limit: int, mark: str, only_at_blank: bool = False) -> list[Piece]:
    """A long piece in parts; later ones repeat its first line and say which part they are."""
    lines = p.text.split("\n")
    ranges = pack(lines, limit, only_at_blank)
    title = lines[0].strip()[:200]
    parts = []
    for n, (a, b) in enumerate(ranges, 1):
        body = "\n".join(lines[a:b])
        text = body if n == 1 else f"{title}\n{mark.format(n, len(ranges))}\n{body}"
        parts.append(replace(p, text=text, first=p.first + a, last=min(p.last, p.first + b - 1)))
    return parts


def chunks(facts: FileFacts, pieces: list[Piece], budget: Budget) -> list[dict]:
    """Pieces with headers, cut so that header and text fit the context; no line is lost."""
    out = []
    for p in pieces:
        top = header(facts, p, budget)
        room = CONTEXT - tokens(top) - MARGIN
        lines = p.text.split("\n")
        ranges = [(0, len(lines))] if tokens(p.text) <= room else pack(lines, room)
        for a, b in ranges:
            whole = (a, b) == (0, len(lines))
            text = p.text if whole else "\n".join(lines[a:b])
            first, last = (p.first, p.last) if whole else (p.first + a, min(p.last, p.first + b - 1))
            embed = f"{top}\n{text}"
            out.append({"path": facts.path, "embed_text": embed, "raw_text": text, "start_line": first, "end_line": last, "symbol": p.symbol, "kind": p.kind, "parent_chain": list(p.parents), "exported": p.exported, "token_count": tokens(embed)})
    return out


def merged(pieces: list[Piece], budget: Budget, prose: bool = False) -> list[Piece]:
    """Small pieces joined to the one before, within the target size.

    In code a small unnamed gap also joins a large neighbour (up to the maximum), and pieces of different
    parents never join.
    """
    out: list[Piece] = []
    for p in pieces:
        if out:
            prev = out[-1]
            gap = not prose and p.symbol is None and p.kind in ("binding", "preamble") and tokens(p.text) < budget.min_tokens
            fits = tokens(prev.text) + tokens(p.text) <= (budget.max_tokens if gap else budget.target_tokens)
            small = tokens(prev.text) < budget.min_tokens or gap
            apart = not prose and ("file_card" in (prev.kind, p.kind) or prev.parents != p.parents)
            if small and fits and not apart and p.first >= prev.first:
                names = [s for s in (prev.symbol, p.symbol) if s]
                kind = p.kind if not prose and not prev.symbol and p.symbol else prev.kind
                out[-1] = replace(prev, text=f"{prev.text}\n\n{p.text}", last=max(prev.last, p.last), kind=kind, symbol=", ".join(names) or None, exported=prev.exported or p.exported, doc=prev.doc if prev.doc is not None else p.doc)
                continue
        out.append(p)
    return out
