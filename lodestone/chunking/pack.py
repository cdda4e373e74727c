"""Greedy line packing, gaps between intervals, and merging of small neighbours.

Packing and merging depend on order, so each is a fold over one file's array of lines or pieces. A file
is bounded by the size limit at admission, and files are folded independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def pack_lines(text: Column, limit: int) -> Column:
    """array<struct<first, last, tokens>>: greedy parts of lines (0-based) up to ``limit`` tokens.

    A part is closed before the line that would exceed the limit; a longer line is a part of its own.
    """
    costs = F.transform(F.split(text, "\n"), lambda s: F.ceil(F.length(s) / F.lit(3.2)).cast("int"))
    part = "struct<first:int,last:int,tokens:int>"
    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("tokens"))

    def step(a: Column, cost: Column) -> Column:
        full = (a["tokens"] + cost > limit) & (a["n"] > a["first"])
        closed = F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["n"] - 1).alias("last"), a["tokens"].alias("tokens"))))
        return F.struct(F.when(full, closed).otherwise(a["done"]).alias("done"), F.when(full, a["n"]).otherwise(a["first"]).alias("first"), (a["n"] + 1).alias("n"), F.when(full, cost).otherwise(a["tokens"] + cost).alias("tokens"))

    return F.aggregate(costs, start, step, lambda a: F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["n"] - 1).alias("last"), a["tokens"].alias("tokens")))))


def gaps(intervals: DataFrame, key: str, start: str, end: str, total: Column | None = None) -> DataFrame:
    """(key, start, end): what a key's half-open intervals leave uncovered between 0 and their reach."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.withColumn("__to", F.coalesce(F.max(end).over(w), F.lit(0)))
    inner = rows.where(F.col(start) > F.col("__to")).select(key, F.col("__to").alias("gap_start"), F.col(start).alias("gap_end"))
    if total is None:
        return inner
    tail = intervals.groupBy(key).agg(F.max(end).alias("gap_start"), F.max(total).alias("gap_end")).where("gap_end > gap_start")
    return inner.unionByName(tail.select(key, "gap_start", "gap_end"))


def merge_small(pieces: Column, minimum: int, target: int) -> Column:
    """Fold of array<struct<tokens, first, last>>: a piece joins the one before while that is small."""
    kind = "struct<tokens:int,first:int,last:int>"

    def step(done: Column, p: Column) -> Column:
        prev = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (prev["tokens"] < minimum) & (prev["tokens"] + p["tokens"] <= target)
        merged = F.struct((prev["tokens"] + p["tokens"]).alias("tokens"), prev["first"].alias("first"), p["last"].alias("last"))
        rest = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(rest, F.array(merged))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(pieces, F.array().cast(f"array<{kind}>"), step)
