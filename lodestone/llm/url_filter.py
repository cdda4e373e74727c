"""URL filters: a rule list, then association rules that FP-growth mines from labelled URLs.

A URL is the set of its tokens (``transaction``): every label of the host, every segment of the path, every
key of the query, and the scheme, extension and fragment. The label of a URL is that of the document it
leads to, whose number is a segment of its path (``/en/7817`` leads to document 7817). Only labelled URLs
that no rule of the list decides are mined: the list's own verdicts teach nothing.

FP-growth over these, with block as one more item, gives rules {tokens} -> block. Where URLs have many
frequent tokens it runs over projections: the URLs that hold some tokens, with the more frequent ones they
hold besides; a projection that is still wide is projected again. Rules are pruned by
support, by confidence, and by significance: a rule stays only if chance alone, at the share of blocked
URLs, would hardly give any of the rules its confidence. A rule goes when a part of its tokens already
implies block. A page is matched by an inverted index: each rule is filed under its rarest token, a page
looks up its own tokens there, and a filed rule holds if the page has its other tokens.

Everything is DataFrame expressions and the JVM's FP-growth.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import forget, written

#: (verdict, host with its subdomains, path prefix), the default rule list of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT, CONFIDENCE = 0.001, 0.9
#: Labelled URLs that must support a rule in any case.
LEAST = 10
#: Rules that chance may give, in all.
CHANCE = 0.01
#: Frequent tokens of one labelled URL up to which FP-growth takes its projection as it is (2^16 sets); wider
#: projections are projected again. It decides the work and never the result.
WIDEST = 16
#: Frequent tokens of all projections, about, that one run of FP-growth takes: it collects them.
TOGETHER = 50_000
#: Rules that are matched from a broadcast index; more are joined by their token.
INDEXED = 5_000
_VERDICT = "verdict:block"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def document_of(path: Column) -> Column:
    """The number of the document that a path leads to: its last segment of digits, an extension aside; or null."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit(r"/([0-9]{1,18})(?=[./]|$)"), 1), F.lit(-1)).cast("long")


def transaction(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, each with its kind; none for a null URL.

    Kinds: scheme, host (each label), tld (the last label), path (each segment), ext, key (each query key)
    and fragment.
    """
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)

    def each(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit(f"{kind}:"), x))

    one = {
        "scheme": F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1),
        "tld": F.substring_index(host, ".", -1),
        "ext": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
        "fragment": F.when(F.instr(url, "#") > 0, F.lit("1")),
    }
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = [each(k, F.array(v)) for k, v in one.items()] + [each("host", F.split(host, r"\.")), each("path", F.split(path, "/")), each("key", keys)]
    return F.array_distinct(F.concat(*parts))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, chance: float = CHANCE) -> DataFrame:
    """``(tokens, block)`` -> written rules ``(tokens, confidence, support)`` that imply block, none implied by another.

    All labelled rows and all their frequent tokens count; ``block`` null is no label. Of tokens that the same
    rows have, the smallest stands for all. No labelled row, or none that blocks, gives no rule.
    """
    spark = labelled.sparkSession
    rows, rows_path = written(labelled.where("block IS NOT NULL").select("tokens", "block").withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("block").cast("double")).alias("share")).first()
    n, share = totals["n"], totals["share"] or 0.0
    if not n or share in (0.0, 1.0):
        found = spark.range(0).select(F.array().cast("array<string>").alias("tokens"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
        rules = written(found, "url-rules")[0]
        forget(spark, rows_path)
        return rules
    least = math.ceil(max(LEAST, support * n) - 1e-9)
    # tokens that too few or all rows have make no rule; those of the same rows make the same rules
    held = rows.select("row", F.explode("tokens").alias("token"))
    known = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("mark")).where((F.col("n") >= least) & (F.col("n") < n))
    known = known.groupBy("n", "mark").agg(F.min("token").alias("token")).select("token", "n")
    rarest_first = F.array_sort(F.collect_list(F.struct("n", "token")))["token"]
    items = rows.select("row", "block").join(held.join(known, "token").groupBy("row").agg(rarest_first.alias("items")), "row")
    sets, sets_path = _frequent(items, least)
    c, tested = F.col("confidence"), sets.count()
    # chance gives a set of n rows a share c of blocked ones with probability exp(-n KL(c, share)) at most
    apart = c * F.log(c / F.lit(share)) + F.when(c < 1, (1 - c) * F.log((1 - c) / F.lit(1 - share))).otherwise(F.lit(0.0))
    rules = sets.where(F.col("blocked") >= least).select("tokens", (F.col("blocked") / F.col("all")).alias("confidence"), (F.col("blocked") / F.lit(n)).alias("support"), "all")
    rules = rules.where((c >= confidence) & (c > share) & (F.col("all") * apart >= F.log(F.lit(max(1, tested) / chance)))).drop("all")
    found = written(_least(rules), "url-rules")[0]
    for path in (rows_path, sets_path):
        forget(spark, path)
    return found


def _frequent(items: DataFrame, least: int) -> tuple[DataFrame, str]:
    """``(row, items, block)``, items rarest first -> written sets ``(tokens, all, blocked)`` that ``least`` rows have,
    and their path: how many rows have them, and how many of these block (0 for fewer than ``least``).

    Listed are the sets of which no part has the same rows; others make no rule that a part doesn't make, and
    are the same test of chance. A projection holds the rows that have all tokens of ``prefix``, with
    their tokens after its last one, so each set is found in one projection alone.
    """
    spark = items.sparkSession
    now, path = written(items.select(F.array().cast("array<string>").alias("prefix"), "row", "block", "items"), "url-items")
    parts: list[tuple[DataFrame, str]] = []
    first = True
    while True:
        wide, wide_path = written(now.groupBy("prefix").agg(F.max(F.size("items")).alias("widest")).where(F.col("widest") > WIDEST).select("prefix"), "url-wide")
        done = wide.isEmpty()
        parts += _grown(now if done else now.join(wide, "prefix", "left_anti"), least, first)
        if done:
            break
        each = now.join(wide, "prefix").select("prefix", "row", "block", "items", F.posexplode("items").alias("pos", "token"))
        after, after_path = written(each.select(F.concat("prefix", F.array("token")).alias("prefix"), "row", "block", F.slice("items", F.col("pos") + 2, F.size("items")).alias("items")), "url-projected")
        counts, counts_path = written(after.groupBy("prefix").agg(F.count(F.lit(1)).alias("all"), F.count_if("block").alias("blocked")), "url-sets")
        parts.append((counts.select(F.array_sort("prefix").alias("tokens"), "all", "blocked"), counts_path))
        # a token that all rows of a projection have makes no set of its own there
        held = after.select("prefix", "row", "block", F.posexplode("items").alias("pos", "token"))
        known = held.groupBy("prefix", "token").agg(F.count(F.lit(1)).alias("n")).join(counts, "prefix").where((F.col("n") >= least) & (F.col("n") < F.col("all")))
        left = held.join(known.select("prefix", "token"), ["prefix", "token"]).groupBy("prefix", "row", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "token")))["token"].alias("items"))
        before = (path, wide_path, after_path)
        now, path = written(left, "url-items")
        first = False
        for old in before:
            forget(spark, old)
    none = spark.range(0).select(F.array().cast("array<string>").alias("tokens"), F.col("id").alias("all"), F.col("id").alias("blocked"))
    sets, sets_path = written(reduce(DataFrame.unionByName, [p[0] for p in parts], none), "url-sets")
    # a set stays if each of its parts, less one token, has more rows; a part that isn't listed has the rows of a smaller one
    less = sets.where(F.size("tokens") > 1).withColumn("part", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))))
    more = less.join(sets.select(F.col("tokens").alias("part"), F.col("all").alias("of")), "part").where(F.col("of") > F.col("all")).groupBy("tokens", "all", "blocked").agg(F.count(F.lit(1)).alias("n"))
    own = written(sets.where(F.size("tokens") == 1).unionByName(more.where(F.col("n") == F.size("tokens")).drop("n")), "url-sets")
    for old in (path, wide_path, sets_path, *(p[1] for p in parts)):
        forget(spark, old)
    return own


def _grown(rows: DataFrame, least: int, one: bool) -> list[tuple[DataFrame, str]]:
    """Frequent sets ``(tokens, all, blocked)`` of projections, written; one: there is a single projection."""
    runs = 1 if one else max(1, math.ceil(rows.select("prefix", F.explode("items")).distinct().count() / TOGETHER))
    out = []
    for run in range(runs):
        some = rows.where(F.pmod(F.xxhash64("prefix"), F.lit(runs)) == run)
        # an item is a token with its prefix, so projections have none in common
        marked = F.when(F.col("block"), F.concat("items", F.array(F.lit(_VERDICT)))).otherwise(F.col("items"))
        items, items_path = written(some.select(F.transform(marked, lambda t: F.concat("prefix", F.array(t))).alias("items")), "url-named")
        n = items.count()
        if n >= least:
            # half a row less, so that rounding asks for no row more
            found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(items).freqItemsets
            have = found.select(F.array_sort(F.array_distinct(F.flatten("items"))).alias("have"), F.size("items").alias("size"), "freq")
            blocks = F.array_contains("have", _VERDICT)
            sets = have.where(~blocks | (F.col("size") > 1)).groupBy(F.array_remove("have", F.lit(_VERDICT)).alias("tokens"))
            out.append(written(sets.agg(F.max(F.when(~blocks, F.col("freq"))).alias("all"), F.coalesce(F.max(F.when(blocks, F.col("freq"))), F.lit(0)).alias("blocked")), "url-sets"))
        forget(rows.sparkSession, items_path)
    return out


def _least(rules: DataFrame) -> DataFrame:
    """The rules that no rule with fewer of their tokens implies."""
    some = rules.select(F.col("tokens").alias("part"), F.array_min("tokens").alias("token"))
    wide = rules.where(F.size("tokens") > 1).select("tokens", F.explode("tokens").alias("token"))
    implied = wide.join(some, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(implied, "tokens", "left_anti")


def matched(pages: DataFrame, rules: DataFrame, tokens_col: str = "tokens", out: str = "matched", indexed: int = INDEXED) -> DataFrame:
    """``pages`` with a flag whether any rule's tokens are all among theirs, by an index on one token a rule."""
    # the token that fewest rules hold is the key, ties to the smaller
    held = rules.withColumn("rule", F.monotonically_increasing_id()).select("rule", F.col("tokens").alias("need"), F.explode("tokens").alias("token"))
    rare = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = held.join(rare, "token").groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("need").alias("need")).groupBy("token").agg(F.collect_list("need").alias("needs"))
    some = rules.limit(indexed + 1).count()
    if not some:
        return pages.withColumn(out, F.lit(False))
    if some <= indexed:
        # one row: a map of at most ``indexed`` rules
        index = filed.agg(F.map_from_entries(F.collect_list(F.struct("token", "needs"))).alias("__ls_index"))
        hit = F.exists(F.col(tokens_col), lambda t: F.exists(F.coalesce(F.col("__ls_index")[t], F.array().cast("array<array<string>>")), lambda need: F.size(F.array_except(need, F.col(tokens_col))) == 0))
        return pages.join(F.broadcast(index)).withColumn(out, hit).drop("__ls_index")
    sets = pages.select(F.col(tokens_col).alias("have")).distinct()
    hits = sets.withColumn("token", F.explode("have")).join(filed, "token").where(F.exists("needs", lambda need: F.size(F.array_except(need, F.col("have"))) == 0)).select("have").distinct()
    return pages.join(hits.withColumn("__ls_hit", F.lit(True)), F.col(tokens_col) == F.col("have"), "left").withColumn(out, F.coalesce("__ls_hit", F.lit(False))).drop("have", "__ls_hit")


def _rows(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str, url_col: str) -> DataFrame:
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    return rows.withColumns({"fit": rule_of(host, path, rules), "tokens": transaction(url, host, path), "doc": document_of(path)})


def labelled(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """The rows of URLs that no rule decides and whose document has a label, with ``block``: low quality or toxic."""
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    marks = labels.groupBy(F.col(label_id).cast("long").alias("doc")).agg(bad.alias("bad")).where("bad IS NOT NULL")
    return rows.where("fit IS NULL").join(marks, "doc").withColumn("block", F.col("bad") == 1)


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Every URL's host, path, the rule that fits it and a verdict: id, host, path, rule, verdict.

    Mined are the URLs that no rule decides and whose document is labelled; those of low quality or toxic
    documents are the blocking examples.

    Cases: a null URL, or one without ://, has empty host and path, fits no rule and has no token of them;
    repeated rows stay, and count as often in the mining; a document labelled twice blocks if either label
    does; null labels and labels of null ids are none; other columns, whatever their names, are ignored;
    without labels only the rule list blocks; an empty table gives an empty result.
    """
    rows = _rows(pages, rules, id_col, url_col)
    found = mine(labelled(rows, labels, label_id), support, confidence)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("matched"), F.lit("block")).otherwise(F.lit("allow")))
    return matched(rows, found).select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def held_out(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """What rules mined from four fifths of the labelled URLs say of the last fifth: pages, bad, blocked, right.

    URLs are dealt by the hash of their document, so that its pages lie on one side.
    """
    known = labelled(_rows(pages, rules, id_col, url_col), labels, label_id).withColumn("fifth", F.pmod(F.xxhash64("doc"), F.lit(5)))
    judged = matched(known.where("fifth = 0"), mine(known.where("fifth <> 0"), support, confidence))
    return judged.agg(F.count(F.lit(1)).alias("pages"), F.count_if("block").alias("bad"), F.count_if("matched").alias("blocked"), F.count_if(F.col("block") & F.col("matched")).alias("right"))
