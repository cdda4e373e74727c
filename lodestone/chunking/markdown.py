"""Markdown in sections along its headings."""

from __future__ import annotations

import re

from lodestone.chunking.pieces import FileFacts, Piece, chunks, cut, merged, tokens
from lodestone.config import Budget

# Patterns of headings and fences, and caps of the card.
HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*\S)\s*$")
FENCE = re.compile(r"^ {0,3}(```|~~~)")
MOST_HEADINGS, MOST_LINKS = 40, 12


def front(lines: list[str]) -> tuple[int, dict[str, str]]:
    """(lines of the leading --- block, its title and description)."""
    if not lines or lines[0].strip() != "---":
        return 0, {}
    end = next((i for i, s in enumerate(lines) if i and s.strip() == "---"), None)
    if end is None:
        return len(lines), {}
    found: dict[str, str] = {}
    for s in lines[1:end]:
        m = re.match(r"(?i)(title|description)\s*:\s*(.+)$", s)
        if m:
            found.setdefault(m[1].lower(), re.sub("^['\"]|['\"]$", "", m[2].strip())[:200])
    return end + 1, found


def sections(lines: list[str]) -> list[tuple[int, str, tuple[str, ...], int, int]]:
    """(level, title, titles above, first, last) of each heading outside fences and the front block."""
    open_fence, above, out = None, [], []
    for i in range(front(lines)[0], len(lines)):
        f = FENCE.match(lines[i])
        if f:
            open_fence = f[1] if open_fence is None else None if lines[i].lstrip().startswith(open_fence) else open_fence
            continue
        m = HEADING.match(lines[i]) if open_fence is None else None
        if m:
            level, title = len(m[1]), re.sub(r"\s*#+\s*$", "", m[2]).strip()
            above = [x for x in above if x[0] < level]
            out.append((level, title, tuple(t for _, t in above), i))
            above.append((level, title))
    ends = [s[3] for s in out[1:]] + [len(lines)]
    return [(lv, t, up, i + 1, e) for (lv, t, up, i), e in zip(out, ends, strict=True)]


def first_prose(lines: list[str]) -> str | None:
    """The first line that is no fence, table or tag, without its bullet; 200 characters."""
    fenced = False
    for s in lines:
        if FENCE.match(s):
            fenced = not fenced
        elif not fenced and (t := s.strip()) and t[0] not in "|<":
            t = re.sub(r"^\d+\.\s+", "", re.sub(r"^[-*+>]\s+", "", t))
            if len(t) > 1:
                return t[:200]
    return None


def links(text: str) -> tuple[str, ...]:
    found = (m[1] for m in re.finditer(r"\]\(([^)\s]+)\)", text))
    own = (h.split("#")[0] for h in found if not re.match(r"(?i)(https?:|mailto:|#)", h))
    return tuple(dict.fromkeys(h for h in own if h))


def chunk(repo: str, path: str, text: str, budget: Budget) -> list[dict]:
    lines = text.split("\n")
    _, said = front(lines)
    found = sections(lines)
    title = said.get("title") or next((t for lv, t, *_ in found if lv == 1), None)
    before = (found[0][3] if found else len(lines) + 1) - 1
    pieces = []
    intro = "\n".join(lines[:before]).strip()
    if intro and (tokens(intro) >= budget.min_tokens or not found):
        pieces.append(Piece(intro, 1, max(1, before), title, "preamble", doc=said.get("description")))
    for _, name, up, a, b in found:
        body = "\n".join(lines[a - 1 : b]).rstrip()
        if body.strip():
            p = Piece(body, a, b, name, "section", up, doc=first_prose(lines[a:b]))
            pieces += [p] if tokens(body) <= budget.max_tokens else cut(p, budget.target_tokens, "<!-- part {}/{} -->", only_at_blank=True)
    names, own = tuple(t for _, t, *_ in found), links(text)
    card = []
    if names or title:
        facts = (f"Document {path}", title and f"Title: {title}", said.get("description") and f"Description: {said['description']}", names and f"Sections: {' · '.join(names[:MOST_HEADINGS])}", own and f"Links to: {', '.join(own[:MOST_LINKS])}")
        card = [Piece("\n".join(f for f in facts if f), 1, 1, title, "file_card", doc=said.get("description"))]
    shared = FileFacts(repo, path, own, names, said.get("description") or title)
    return chunks(shared, card + merged(pieces, budget, prose=True), budget)
