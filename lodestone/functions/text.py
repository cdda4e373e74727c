"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters per token, the context of the embedder, the cap of header lists.
CHARS_PER_TOKEN = 3.2
MODEL_CONTEXT = 2048
MAX_LIST = 12
#: Prefix by (model family, kind of input); an unknown pair is an error.
PREFIXES = {("gemma", "query"): "task: search result | query: ", ("gemma", "document"): "title: none | text: ", ("e5", "query"): "query: ", ("e5", "document"): "passage: "}


def split_identifiers(t: Column) -> Column:
    """Acronym and word, camel case and the separators _ - / . taken apart."""
    t = F.regexp_replace(t, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(t, r"[_\-/.]+", " ")


def code_tokens(t: Column) -> Column:
    """The text followed by its identifiers taken apart; null stays null."""
    return F.concat(t, F.lit(" "), split_identifiers(t))


def code_query(q: Column) -> Column:
    """Distinct query terms of two or more ASCII letters, digits; terms with _ are covered by their parts."""
    words = F.split(F.lower(code_tokens(q)), r"[^a-z0-9_]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.contains(w, F.lit("_"))))


def words(t: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lexemes(t: Column) -> Column:
    """Words of a text as the index sees them: runs of letters and digits, with identifiers taken apart."""
    return words(code_tokens(t))


def estimate_tokens(t: Column) -> Column:
    return F.ceil(F.length(t) / F.lit(CHARS_PER_TOKEN)).cast("long")


def truncate_to_tokens(t: Column, n: int) -> Column:
    return F.substring(t, 1, int(n * CHARS_PER_TOKEN))


def content_hash(model: Column, embed_text: Column) -> Column:
    """SHA-256 of the model id, a zero byte and the text, so that vector spaces never mix."""
    return F.sha2(F.concat(model, F.lit("\0"), embed_text), 256)


def blob_sha(content: Column) -> Column:
    """The object id that git gives a file's bytes."""
    return F.sha1(F.concat(F.lit(b"blob "), F.octet_length(content).cast("string").cast("binary"), F.lit(b"\0"), content))


def path_words(path: Column) -> Column:
    bare = F.regexp_replace(path, r"(?i)\.[a-z]+$", "")
    apart = F.regexp_replace(F.regexp_replace(bare, r"[/\\._\-]+", " "), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_join(F.filter(F.split(apart, r"\s+"), lambda w: F.length(w) > 1), " ")


def capped_list(items: Column, cap: int = MAX_LIST) -> Column:
    """The items joined, those beyond the cap as a count."""
    n = F.size(items)
    shown = F.array_join(F.slice(items, 1, cap), ", ")
    return F.when(n <= cap, F.array_join(items, ", ")).otherwise(F.concat(shown, F.lit(" (+"), (n - cap).cast("string"), F.lit(")")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def is_markdown(path: Column) -> Column:
    return path.rlike(r"(?i)\.(md|mdx|markdown)$")


def lang_for(path: Column) -> Column:
    e = extension(path)
    code = F.when(e.isin("ts", "mts", "cts"), "typescript").when(e == "tsx", "tsx").when(e == "jsx", "jsx").otherwise("javascript")
    return F.when(e == "mdx", "mdx").when(is_markdown(path), "markdown").otherwise(code)


def collapse_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def model_input(t: Column, family: str, kind: str) -> Column:
    """Prefix for the kind of input, then white space collapsed (the prefix's own too)."""
    if (family, kind) not in PREFIXES:
        raise ValueError(f"no prefix for {family} and {kind}")
    return collapse_space(F.concat(F.lit(PREFIXES[family, kind]), t))


def truncated(t: Column, context: int = MODEL_CONTEXT) -> Column:
    return F.length(t) / F.lit(CHARS_PER_TOKEN) > context


def path_prefix(path: Column, depth: int) -> Column:
    """The first ``depth`` segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def relative_links(t: Column) -> Column:
    """Distinct link targets of Markdown that are not URLs, mail addresses or fragments, in order."""
    found = F.regexp_extract_all(t, F.lit(r"\]\(([^)\s]+)\)"), 1)
    own = F.filter(found, lambda h: ~h.rlike(r"(?i)^(https?:|mailto:|#)"))
    return F.filter(F.array_distinct(F.transform(own, lambda h: F.substring_index(h, "#", 1))), lambda h: h != "")


def frontmatter_field(t: Column, name: str) -> Column:
    """A field of the leading --- block, quotes stripped, 200 characters; empty when there is none."""
    block = F.regexp_extract(t, r"(?s)^[ \t]*---[ \t]*\n(.*?\n)?[ \t]*---[ \t]*(?:\n|$)", 1)
    value = F.trim(F.regexp_extract(block, rf"(?im)^{name}\s*:\s*(.+)$", 1))
    return F.substring(F.regexp_replace(value, "^['\"]|['\"]$", ""), 1, 200)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def length_bucket(n: Column, edges: Sequence[int] = (128, 256, 512, 1024, 2048)) -> Column:
    """The smallest bucket that a length fits in; the last takes the rest."""
    out = F.lit(edges[-1])
    for e in reversed(edges[:-1]):
        out = F.when(n <= e, e).otherwise(out)
    return out


def trim_lines(t: Column, most: int = 15, head: int = 10, tail: int = 4) -> Column:
    """A long text as its first and last lines with a marker between."""
    lines = F.split(t, "\n")
    n = F.size(lines)
    cut = F.concat(F.slice(lines, 1, head), F.array(F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines"))), F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)))
    return F.when(n > most, F.array_join(cut, "\n")).otherwise(t)


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def glob_regex(glob: str) -> str:
    """A path glob (``**``, ``*``, ``?``, names with a leading dot included) as a regular expression."""
    import re

    out, i = "^", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out + "$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)
