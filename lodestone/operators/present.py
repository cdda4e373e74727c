"""Presentation: budget cuts, order notices, repository maps and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens, path_prefix

# Fixed values of the overview: symbols kept and shown, tokens a symbol.
MOST_SYMBOLS, SHOWN, PER_SYMBOL = 40, (3, 25), 4


def budget_cut(rows: DataFrame, budget: int, cost: Column) -> DataFrame:
    """Rows of a question in order while their running cost fits; the first always stays."""
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = rows.withColumn("cost", cost).withColumn("spent", F.sum("cost").over(w))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    over = spent.withColumn("__over", (F.col("spent") > budget) & (first > 1))
    # costs are not negative, so what follows an excess exceeds too
    return over.where(~F.col("__over")).drop("__over")


def order_notice(rows: DataFrame) -> DataFrame:
    """(query_id, reordered): whether a similarity rises somewhere down the list (null ones aside)."""
    w = Window.partitionBy("query_id").orderBy("pos")
    up = rows.where("sim IS NOT NULL").withColumn("__up", F.coalesce(F.col("sim") > F.lag("sim").over(w), F.lit(False)))
    return up.groupBy("query_id").agg(F.bool_or("__up").alias("reordered"))


def expand_context(docs: DataFrame, start: int, end: int, before: int = 20, after: int = 20, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, text, inside): the lines around a range, clamped to the text."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "text"))
    at = F.col("n") + 1
    return lines.where(at.between(max(1, start - before), end + after)).select(id_col, at.cast("int").alias("line"), "text", at.between(start, end).alias("inside"))


def overview(rows: DataFrame, depth: int = 2, path_col: str = "path", symbol_col: str = "symbol", shown: Column | None = None) -> DataFrame:
    """(dir, files, symbols): distinct files and the first distinct symbols under each path prefix."""
    named = F.when(F.lit(True) if shown is None else shown, F.col(symbol_col))
    per = rows.withColumn("dir", path_prefix(F.col(path_col), depth)).groupBy("dir")
    return per.agg(F.count_distinct(path_col).alias("files"), F.slice(F.array_sort(F.collect_set(named)), 1, MOST_SYMBOLS).alias("symbols"))


def symbol_cap(dirs: Column, budget: int) -> Column:
    low, high = SHOWN
    return F.least(F.lit(high), F.greatest(F.lit(low), F.round(F.lit(float(budget)) / dirs / PER_SYMBOL).cast("int")))


def pack_map(rows: DataFrame, budget: int) -> DataFrame:
    """The directories of an overview that fit the budget: dir, files, block, kept.

    Heaviest first, ties by name; one that does not fit is passed over and later ones may still fit; the
    first is always kept. The fold runs over one sorted array of blocks, as many as there are directories.
    """
    cap = symbol_cap(F.col("dirs"), budget)
    head = F.concat(F.col("dirs").cast("string"), F.lit(" directories, "), F.col("total").cast("string"), F.lit(" files"))
    shown = F.slice("symbols", F.lit(1), cap)
    rest = F.size("symbols") - F.size(shown)
    listed = F.when(F.size(shown) == 0, F.lit("-")).otherwise(F.concat(F.array_join(shown, ", "), F.when(rest > 0, F.concat(F.lit(" (+"), rest.cast("string"), F.lit(")"))).otherwise(F.lit(""))))
    name = F.when(F.col("dir").rlike(r"(?i)\.[a-z]+$"), F.col("dir")).otherwise(F.concat("dir", F.lit("/")))
    totals = rows.agg(F.count(F.lit(1)).alias("dirs"), F.sum("files").alias("total"))
    blocks = rows.join(F.broadcast(totals)).withColumn("block", F.concat(name, F.lit("  ("), F.col("files").cast("string"), F.lit(" files)\n  exports: "), listed)).withColumn("cost", estimate_tokens(F.col("block")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("w"), "dir", "cost")))
    start = F.struct(F.first(estimate_tokens(head)).alias("spent"), F.array().cast("array<string>").alias("kept"))
    folded = blocks.agg(order.alias("o"), start.alias("s")).select(
        F.aggregate("o", F.col("s"), lambda a, x: F.when((F.size(a["kept"]) > 0) & (a["spent"] + x["cost"] > budget), a).otherwise(F.struct((a["spent"] + x["cost"]).alias("spent"), F.concat(a["kept"], F.array(x["dir"])).alias("kept"))))["kept"].alias("names"))
    return blocks.join(F.broadcast(folded)).select("dir", "files", "block", F.array_contains("names", F.col("dir")).alias("kept"))


def format_hits(rows: list, budget: int = 4000) -> str:
    """At most k collected hits as text: path and lines, similarity, body cut to its first and last lines."""
    out, spent, sims = [], 0, [r["sim"] for r in rows if r["sim"] is not None]
    for i, r in enumerate(rows, 1):
        lines = r["raw_text"].split("\n")
        body = r["raw_text"] if len(lines) <= 15 else "\n".join([*lines[:10], f"... {len(lines) - 14} lines", *lines[-4:]])
        label = f"{r['kind']} {' > '.join([*(r['parent_chain'] or []), r['symbol']])}" if r["symbol"] else r["kind"]
        sim = "" if r["sim"] is None else f" sim {r['sim']:.3f}"
        block = f"{i}. {r['path']}:{r['start_line']}-{r['end_line']}  {label}{sim}\n{body}"
        cost = -(-len(block) * 10 // 32)
        if out and spent + cost > budget:
            break
        out.append(block)
        spent += cost
    if any(b > a for a, b in zip(sims, sims[1:], strict=False)):
        out.append("Note: the order follows priors and reranking, not similarity alone.")
    return "\n\n".join(out)

