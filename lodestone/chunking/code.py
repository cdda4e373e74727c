"""TypeScript and JavaScript in chunks along top-level statements.

There is no parser here: a lexer walks strings, templates, comments, regular expressions and brackets,
cuts the text into top-level statements, and patterns on a statement's head say what it declares.
"""

from __future__ import annotations

import re
from dataclasses import replace

from lodestone.chunking.pieces import FileFacts, Piece, chunks, cut, merged, tokens
from lodestone.config import Budget

# Callee names that say nothing, the cap of callers, the size limit for the call map.
IGNORED_CALLS = frozenset(
    "map filter forEach reduce push then catch log error warn get set has add delete test expect describe it "
    "require join split slice toString keys values entries".split()
)
MOST_CALLERS, MOST_CALL_TEXT = 3, 512 * 1024
_NAME = r"[A-Za-z_$][\w$]*"
_KEYWORDS = frozenset("if for while switch catch return function typeof new await else do try in of void delete instanceof case throw yield super import class extends async".split())
_BEFORE_REGEX = frozenset("return typeof case in of do else void delete throw new instanceof await yield".split())


def lex(text: str) -> list[tuple[str, int, int]]:
    """Tokens (kind, start, end): word, number, string, template, regex, comment, newline, or the sign."""
    out: list[tuple[str, int, int]] = []
    i, n = 0, len(text)
    last = None  # the token before, comments and line ends aside
    while i < n:
        c = text[i]
        if c == "\n":
            kind, end = "newline", i + 1
        elif c.isspace():
            i += 1
            continue
        elif text.startswith("//", i):
            kind, end = "comment", text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            at = text.find("*/", i + 2)
            kind, end = "comment", n if at < 0 else at + 2
        elif c in "'\"":
            end = i + 1
            while end < n and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            kind, end = "string", min(end + 1, n)
        elif c == "`":
            kind, end = "template", _template(text, i)
        elif m := re.compile(rf"#?{_NAME}|\d[\w.]*").match(text, i):
            kind, end = ("number" if c.isdigit() else "word"), m.end()
        elif c == "/" and _starts_regex(text, last) and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n\\])*\]|[^/\n\\\[])+/[a-z]*").match(text, i)):
            kind, end = "regex", m.end()
        elif text.startswith("=>", i):
            kind, end = "=>", i + 2
        else:
            kind, end = c, i + 1
        out.append((kind, i, end))
        if kind not in ("newline", "comment"):
            last = out[-1]
        i = end
    return out


def _starts_regex(text: str, last: tuple[str, int, int] | None) -> bool:
    if last is None:
        return True
    kind, a, b = last
    return text[a:b] in _BEFORE_REGEX if kind == "word" else kind not in ("number", "string", "template", "regex", ")", "]", "}")


def _template(text: str, i: int) -> int:
    """End of a template literal, whose ${...} may hold more of them."""
    i += 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template(text, i)
                    continue
                if m := re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"").match(text, i):
                    i = m.end()
                    continue
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
        else:
            i += 1
    return len(text)


def statements(text: str, toks: list[tuple[str, int, int]], level: int = 0) -> list[list[tuple[str, int, int]]]:
    """Token lists of the statements at the top level.

    A statement ends with a semicolon, with the brace that closes a declaration's body, or at a line end
    after which a new one can begin.
    """
    out, now, depth = [], [], 0
    code = [t for t in toks if t[0] != "comment"]
    for k, (kind, a, b) in enumerate(code):
        if kind == "newline":
            if depth == 0 and now and _may_end(text, now, _next(code, k)):
                out.append(now)
                now = []
            continue
        now.append((kind, a, b))
        depth += (kind in "([{") - (kind in ")]}") if len(kind) == 1 else 0
        if depth <= 0:
            depth = 0
            body = kind == "}" and re.match(r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|enum|namespace|module)\b", text[now[0][1] :])
            after = _next(code, k)
            if kind == ";" or (body and not (after and text[after[1] : after[2]] in ("extends", "implements", "{"))):
                out.append(now)
                now = []
    return [*out, now] if now else out


def _next(code: list[tuple[str, int, int]], k: int) -> tuple[str, int, int] | None:
    return next((t for t in code[k + 1 :] if t[0] != "newline"), None)


def _may_end(text: str, now: list[tuple[str, int, int]], after: tuple[str, int, int] | None) -> bool:
    """Whether a line end closes a statement, by the signs on both sides of it."""
    end = text[now[-1][1] : now[-1][2]]
    if end in ("=", "=>", "+", "-", "*", "%", "&", "|", "^", "<", "?", ":", ",", ".", "!", "~", "extends", "implements", "export", "default", "async", "new", "return", "function", "class"):
        return False
    if after is None:
        return True
    begins = text[after[1] : after[2]]
    return begins not in (".", "?", ":", "=", "=>", "+", "*", "%", "&", "|", "^", ",", ")", "]", "}", "{", "extends", "implements", "instanceof", "in", "as") and not begins.startswith("`")


def doc_line(comment: str) -> str | None:
    """The first line of a doc comment that says something, 200 characters."""
    for s in comment.split("\n"):
        t = re.sub(r"\*/\s*$", "", re.sub(r"^\s*/?\*+", "", s)).strip()
        if t and not t.startswith("@"):
            return t[:200]
    return None


def module_doc(text: str, toks: list[tuple[str, int, int]]) -> tuple[str | None, int]:
    """(first line, end) of a doc comment that describes the file.

    It is the first comment of the file, and either a tag says so or what follows isn't a declaration
    right below it (another doc comment, an import, or a blank line).
    """
    first = next((t for t in toks if t[0] != "newline"), None)
    if not first or first[0] != "comment" or not text[first[1] : first[2]].startswith("/**"):
        return None, -1
    body, rest = text[first[1] : first[2]], text[first[2] :]
    alone = re.match(r"[ \t]*\n[ \t]*\n", rest) or re.match(r"\s*(?:/\*\*|import\b|['\"]use |$)", rest) or re.match(r"\s*(?:const|let|var)\s+.*=\s*require\(", rest)
    return (doc_line(body), first[2]) if alone or re.search(r"@(?:module|file|fileoverview|packageDocumentation)\b", body) else (None, -1)


def _doc_before(text: str, toks: list[tuple[str, int, int]], start: int, floor: int) -> tuple[str | None, int]:
    """The doc comment right above a statement, and where the two begin together."""
    for kind, a, b in reversed([t for t in toks if t[2] <= start]):
        if kind == "comment":
            if text[a:b].startswith("/**") and b > floor:
                return doc_line(text[a:b]), a
        elif kind != "newline":
            break
    return None, start


def _functional(value: str) -> str | None:
    """function or class, for an initializer that is one."""
    if re.match(r"(?:abstract\s+)?class\b", value):
        return "class"
    if re.match(r"(?:async\s+)?function\b", value) or re.match(rf"(?:async\s+)?(?:<[^=]*>\s*)?{_NAME}\s*=>", value):
        return "function"
    m = re.match(r"(?:async\s*)?(?:<[^()]*>\s*)?\(", value)
    if m:
        depth = 0
        for kind, _, b in lex(value[m.end() - 1 :]):
            depth += {"(": 1, ")": -1}.get(kind, 0)
            if depth == 0:
                rest = value[m.end() - 1 + b :]
                return "function" if re.match(r"\s*(?::[^=;{]*(?:\{[^}]*\})?[^=;]*)?=>", rest) else None
    return None


def parse(path: str, text: str, budget: Budget) -> tuple[list[str], list[str], list[tuple[int, int, Piece]], str | None, int]:
    """(imports, exports, [(start, end, piece)], module doc, number of statements)."""
    toks = lex(text)
    said, floor = module_doc(text, toks)
    found: list[tuple[int, int, Piece]] = []
    imports: list[str] = []
    exports: list[str] = []
    common: list[str] = []
    local: set[str] = set()
    jsx = bool(re.search(r"(?i)\.(tsx|jsx)$", path))
    parts = statements(text, toks)

    def add(a: int, b: int, symbol: str | None, kind: str, exported: bool, parents=(), parent_doc=None) -> None:
        doc, start = _doc_before(text, toks, a, floor)
        found.append((start, b, Piece("", 0, 0, symbol, kind, tuple(parents), exported, doc, parent_doc)))

    for st in parts:
        a, b = st[0][1], st[-1][2]
        s = text[a:b]
        if (m := re.match(r"import\b[\s\S]*?['\"]([^'\"]+)['\"]", s)) and not re.match(r"import\s*\(", s):
            imports.append(m[1])
            continue
        if m := re.match(r"export\s+(?:type\s+)?(\*|\{)", s):
            if src := re.search(r"\bfrom\s+['\"]([^'\"]+)['\"]", s):
                imports.append(src[1])
            if m[1] == "{":
                inside = re.sub(r"/\*[\s\S]*?\*/|//.*", "", s[s.index("{") + 1 : s.index("}")])
                exports += [x.split()[-1] for x in inside.split(",") if x.split()]
            continue
        out = bool(re.match(r"export\b", s))
        head = re.sub(r"^export\s+(?:default\s+)?", "", s)
        head = re.sub(r"^(?:declare\s+)", "", head)
        if m := re.match(rf"(?:async\s+)?function\s*\*?\s*({_NAME})?", head):
            if out and m[1]:
                exports.append(m[1])
            add(a, b, m[1], "component" if jsx and m[1] and m[1][0].isupper() else "function", out)
        elif m := re.match(rf"(?:abstract\s+)?class\b\s*(?!extends\b|implements\b)({_NAME})?", head):
            if out and m[1]:
                exports.append(m[1])
            if tokens(s) <= budget.max_tokens:
                add(a, b, m[1], "class", out)
            else:
                doc = _doc_before(text, toks, a, floor)[0]
                for x, y, name in _members(text, st):
                    add(x, y, name, "method", False, [m[1]] if m[1] else [], doc)
        elif m := re.match(rf"(?:interface|type|(?:const\s+)?enum)\s+({_NAME})", head):
            if out:
                exports.append(m[1])
            add(a, b, m[1], "type", out)
        elif re.match(r"(?:const|let|var)\b", head):
            decls = _declarations(text, st)
            named = [(x, y, n, k) for x, y, n, v in decls if (k := _functional(v))]
            if not named:
                if tokens(s) >= budget.min_tokens:
                    symbol = next((n for _, _, n, _ in decls if n), None)
                    if out and symbol:
                        exports.append(symbol)
                    add(a, b, symbol, "binding", out)
            for x, y, n, k in named:
                if out and n:
                    exports.append(n)
                kind = "component" if k == "function" and jsx and n and n[0].isupper() else k
                add(*((a, b) if len(named) == 1 else (x, y)), n, kind, out)
        elif re.match(r"export\s+default\b|export\s*=", s):
            exports.append("default")
        elif m := re.match(rf"module\s*\.\s*exports\s*=\s*(?:({_NAME})\s*;?\s*$|\{{)", s):
            if m[1]:
                common.append(m[1])
            else:
                for name, alias in _properties(text, st):
                    common.append(name)
                    local |= {alias} if alias else set()
        elif m := re.match(rf"exports\s*\.\s*({_NAME})\s*=(?!=)\s*(?:({_NAME})\s*;?\s*$)?", s):
            common.append(m[1])
            local |= {m[2]} if m[2] else set()
    shown = {*common, *local}
    found = [(x, y, replace(p, exported=p.exported or p.symbol in shown)) for x, y, p in found]
    return list(dict.fromkeys(imports)), list(dict.fromkeys([*exports, *common])), sorted(found, key=lambda f: f[:2]), said, len(parts)


def _split_at(text: str, toks: list[tuple[str, int, int]], sign: str) -> list[list[tuple[str, int, int]]]:
    """Tokens cut at a sign outside brackets."""
    out, now, depth = [], [], 0
    for t in toks:
        if t[0] == sign and depth == 0:
            out.append(now)
            now = []
            continue
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t[0], 0)
        now.append(t)
    return [x for x in [*out, now] if x]


def _declarations(text: str, st: list[tuple[str, int, int]]) -> list[tuple[int, int, str | None, str]]:
    """(start, end, name, initializer) of each variable of a statement."""
    at = next(i for i, t in enumerate(st) if text[t[1] : t[2]] in ("const", "let", "var"))
    body = [t for t in st[at + 1 :] if t[0] != ";"]
    out = []
    for part in _split_at(text, body, ","):
        a, b = part[0][1], part[-1][2]
        sides = _split_at(text, part, "=")
        value = text[sides[1][0][1] : b] if len(sides) > 1 else ""
        out.append((a, b, text[a : part[0][2]] if part[0][0] == "word" else None, value))
    return out


def _properties(text: str, st: list[tuple[str, int, int]]) -> list[tuple[str, str | None]]:
    """(name, local name it stands for) of an object literal's own properties."""
    a = next(i for i, t in enumerate(st) if t[0] == "{")
    b = max(i for i, t in enumerate(st) if t[0] == "}")
    out = []
    for part in _split_at(text, st[a + 1 : b], ","):
        if part[0][0] != "word":
            continue
        name = text[part[0][1] : part[0][2]]
        if name in ("async", "get", "set") and len(part) > 1 and part[1][0] == "word":
            name = text[part[1][1] : part[1][2]]
        alias = text[part[2][1] : part[2][2]] if len(part) == 3 and part[1][0] == ":" and part[2][0] == "word" else None
        out.append((name, alias))
    return out


def _members(text: str, st: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, name) of methods, constructors and accessors in a class body."""
    a = next(i for i, t in enumerate(st) if t[0] == "{")
    out, i, end = [], a + 1, len(st) - 1
    while i < end:
        j, depth, call = i, 0, None
        while j < end:
            kind = st[j][0]
            if kind == "(" and depth == 0 and call is None:
                call = j
            if kind == "=" and depth == 0 and call is None:
                call = -1
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(kind, 0)
            j += 1
            if depth == 0 and (kind == ";" or (kind == "}" and call != -1)):
                break
            if depth == 0 and call == -1 and j < end and "\n" in text[st[j - 1][2] : st[j][1]] and kind in ("}", ")", "]", "word", "number", "string"):
                break
        if call is not None and call > i and st[call - 1][0] == "word" and st[j - 1][0] == "}":
            out.append((st[i][1], st[j - 1][2], text[st[call - 1][1] : st[call - 1][2]]))
        i = j
    return out


def uncovered(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, is the head) of what the spans leave, without white space at its ends."""
    out, at = [], 0
    for a, b in [*sorted(spans), (len(text), len(text))]:
        raw = text[at:a]
        if raw.strip():
            lead = len(raw) - len(raw.lstrip())
            out.append((at + lead, at + lead + len(raw.strip()), at == 0))
        at = max(at, b)
    return out


def chunk(repo: str, path: str, text: str, budget: Budget, callers: dict[str, list[str]] | None = None) -> list[dict]:
    imports, exports, found, said, n = parse(path, text, budget)
    line = lambda at: text.count("\n", 0, at) + 1
    pieces: list[Piece] = []
    for a, b, p in found:
        p = replace(p, text=text[a:b], first=line(a), last=line(max(a, b - 1)))
        pieces += [p] if tokens(p.text) <= budget.max_tokens else cut(p, budget.target_tokens, "// ... part {}/{}")
    for a, b, head in uncovered(text, [(a, b) for a, b, _ in found]):
        pieces.append(Piece(text[a:b], line(a), line(b - 1), None, "preamble" if head else "binding"))
    pieces.sort(key=lambda p: (p.first, p.last))
    card = []
    if imports or exports:
        top = re.search(r"/\*\*([\s\S]*?)\*/", text[:3000])
        lines = [re.sub(r"^\s*\*?\s?", "", s).strip() for s in top[1].split("\n")] if top else []
        summary = " ".join([s for s in lines if s][:3]) or None
        facts = (f"Module {path}", summary and f"Description: {summary}", exports and f"Exports: {', '.join(exports)}", imports and f"Depends on: {', '.join(imports)}", f"Top-level statements: {n}")
        card = [Piece("\n".join(f for f in facts if f), 1, 1, None, "file_card", doc=summary)]
    shared = FileFacts(repo, path, tuple(imports), tuple(exports), said, callers or {})
    return chunks(shared, card + merged(pieces, budget), budget)


def calls(path: str, text: str) -> list[tuple[str, str]]:
    """(callee, caller) by name alone: ``f()`` and ``x.f()`` are both f; the caller is the closest named
    declaration around."""
    if not re.search(r"(?i)\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$", path) or len(text) > MOST_CALL_TEXT:
        return []
    toks = [t for t in lex(text) if t[0] not in ("comment", "newline")]
    word = lambda i: text[toks[i][1] : toks[i][2]] if 0 <= i < len(toks) and toks[i][0] == "word" else None
    out, scopes, depth, waiting = [], [], 0, None
    for i, (kind, _, _) in enumerate(toks):
        if kind in ("(", "[", "{"):
            if kind == "(" and (name := word(i - 1)) and name not in _KEYWORDS and word(i - 2) not in ("function", "new"):
                method = _is_method(toks, i)
                if method:
                    waiting = name
                elif name not in IGNORED_CALLS and len(name) > 2 and (owner := scopes[-1][0] if scopes else None) and owner != name:
                    out.append((name, owner))
            if kind == "{" and waiting:
                scopes.append((waiting, depth))
                waiting = None
            depth += 1
        elif kind in (")", "]", "}"):
            depth -= 1
            while scopes and scopes[-1][1] >= depth and kind == "}":
                scopes.pop()
        elif kind == "word":
            w = word(i)
            if w in ("function", "class") and word(i + 1) not in (None, "extends"):
                waiting = word(i + 1)
            elif w in ("const", "let", "var") and word(i + 1):
                waiting = word(i + 1)
        elif kind == ";" and not (scopes and depth > scopes[-1][1] + 1):
            waiting = None
    return sorted(set(out))


def _is_method(toks: list[tuple[str, int, int]], i: int) -> bool:
    """Whether the parenthesis at i opens the parameters of a method: a brace follows its end."""
    depth = 0
    for j in range(i, len(toks)):
        depth += {"(": 1, ")": -1}.get(toks[j][0], 0)
        if depth == 0:
            return j + 1 < len(toks) and toks[j + 1][0] == "{" and (i < 2 or toks[i - 2][0] != ".")
    return False
