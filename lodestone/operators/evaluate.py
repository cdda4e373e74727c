"""Measures of ranking: recall, reciprocal rank, depth, health of an approximate index, acceptance."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import MODEL_CONTEXT
from lodestone.functions.text import truncated as is_cut


def match_keys(path: Column, symbol: Column, parents: Column) -> Column:
    """What a result answers to: its path, and path::name for each symbol and parent."""
    names = F.concat(F.filter(F.transform(F.split(F.coalesce(symbol, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != ""), F.coalesce(parents, F.array().cast("array<string>")))
    return F.concat(F.array(path), F.transform(names, lambda s: F.concat(path, F.lit("::"), s)))


def first_hits(questions: DataFrame, results: DataFrame, hit: Column) -> DataFrame:
    """(query_id, rank): every question with the rank of its first hit, or null."""
    found = results.where(hit).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return questions.select("query_id").distinct().join(found, "query_id", "left")


def recall_mrr(ranks: DataFrame, depths: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: queries, recall at each depth and MRR; a miss adds 0 to both."""
    at = [F.round(F.avg(F.coalesce(F.col("rank") <= d, F.lit(False)).cast("double")), 6).alias(f"recall_{d}") for d in depths]
    within = F.when(F.col("rank") <= max(depths), F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("queries"), *at, F.round(F.avg(within), 6).alias("mrr"))


def nearest_rank(column: str, p: float) -> Column:
    """Element floor(n p) of the sorted non-null values: never interpolated."""
    values = F.array_sort(F.collect_list(column))
    return F.element_at(values, (F.floor(F.size(values) * F.lit(p)) + 1).cast("int"))


def nearest_ranks(df: DataFrame, column: str, ps: dict[str, float]) -> DataFrame:
    """One row of nearest-rank percentiles, from counts per value, so no list of all values is made.

    Suits any number of rows: counts are pre-aggregated, and a running total over distinct values picks.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # ranges of values are totalled first, so the running total runs inside a range
    ranged = counts.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    totals = ranged.groupBy("part").agg(F.sum("n").alias("t"))
    ahead = totals.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("total"))
    run = ranged.withColumn("inner", F.sum("n").over(Window.partitionBy("part").orderBy("x"))).join(F.broadcast(ahead), "part").withColumn("upto", F.col("ahead") + F.col("inner"))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * F.lit(p)), F.col("x"))).alias(name) for name, p in ps.items()]
    return run.agg(*picks)


def depth_profile(ranks: DataFrame, depths: tuple[int, ...] = (1, 5, 10, 50, 300)) -> DataFrame:
    """One row: recall at depths, missing, and the median rank of those found (element floor(n / 2))."""
    at = [F.round(F.avg(F.coalesce(F.col("rank") <= d, F.lit(False)).cast("double")), 6).alias(f"at_{d}") for d in depths]
    return ranks.agg(F.count(F.lit(1)).alias("queries"), *at, F.count_if(F.col("rank").isNull()).alias("missing"), nearest_rank("rank", 0.5).alias("median_rank"))


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    return F.when(n == 0, F.lit(0.0)).otherwise((p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))


def collapse(chains: DataFrame, found: Column) -> DataFrame:
    """Calls before and after: a hit costs one call, a miss one more than before."""
    after = F.when(found, F.lit(1)).otherwise(F.col("calls") + 1)
    return chains.agg(F.count(F.lit(1)).alias("chains"), F.count_if(found).alias("collapsed"), F.sum("calls").cast("long").alias("before"), F.sum(after).cast("long").alias("after"))


def rank_histogram(ranks: DataFrame, edges: tuple[int, ...] = (1, 5, 10, 20, 50, 100, 300)) -> DataFrame:
    """(bucket, n): buckets up to each edge, beyond the last and missing share the eighth."""
    label = F.lit(f"over_{edges[-1]}")
    for e in reversed(edges):
        label = F.when(F.col("rank") <= e, f"to_{e}").otherwise(label)
    return ranks.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def clustering(results: DataFrame, top: int = 20, path_col: str = "path") -> DataFrame:
    """(query_id, files, most): distinct files among the first rows, and most rows of one file."""
    per = results.where(F.col("rank") <= top).groupBy("query_id", path_col).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("query_id").agg(F.count(F.lit(1)).alias("files"), F.max("n").alias("most"))


def union_availability(ranks: DataFrame, depth: int, id_col: str = "id") -> DataFrame:
    """(query_id, size, branches): distinct candidates of all branches to a depth."""
    return ranks.where(F.col("rank") <= depth).groupBy("query_id").agg(F.count_distinct(id_col).alias("size"), F.count_distinct("branch").alias("branches"))


def unique_contribution(hits: DataFrame) -> DataFrame:
    """(query_id, branch) hits -> (branch, hits, alone): questions that only this branch answers."""
    per = hits.distinct().groupBy("query_id").agg(F.collect_set("branch").alias("b"))
    rows = per.select(F.explode("b").alias("branch"), (F.size("b") == 1).alias("one"))
    return rows.groupBy("branch").agg(F.count(F.lit(1)).alias("hits"), F.count_if("one").alias("alone"))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided binomial p of a paired sign test."""
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def overlap(exact: DataFrame, other: DataFrame, id_col: str = "id") -> DataFrame:
    """(query_id, exact, shared, overlap) of two top-k lists; an empty exact list counts as full overlap."""
    a = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("exact"))
    b = exact.join(other, ["query_id", id_col], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"))
    return a.join(b, "query_id", "left").select("query_id", "exact", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.round(F.coalesce(F.col("shared") / F.col("exact"), F.when(F.col("exact") == 0, 1.0).otherwise(0.0)), 6).alias("overlap"))


def lost_answers(exact: DataFrame, other: DataFrame, hit: Column) -> DataFrame:
    """(query_id, lost): whether the exact list holds a hit and the other list none.

    Both lists carry the columns that ``hit`` looks at. Questions without an exact list are left out.
    """
    a = exact.groupBy("query_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("found"))
    b = other.groupBy("query_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("reached"))
    return a.join(b, "query_id", "left").select("query_id", (F.col("found") & ~F.coalesce("reached", F.lit(False))).alias("lost"))


def bloat(stored: DataFrame, live: DataFrame, key: str = "content_hash") -> DataFrame:
    """(stored, live, bloat): rows kept for each row that is live; 0 when none is."""
    mine = stored.select(key).join(live.select(key).distinct().withColumn("is_live", F.lit(1)), key, "left")
    n = mine.agg(F.count(F.lit(1)).alias("stored"), F.count("is_live").alias("live"))
    return n.withColumn("bloat", F.round(F.coalesce(F.try_divide("stored", "live"), F.lit(0.0)), 6))


def embed_stats(texts: DataFrame, text_col: str = "text", context: int = MODEL_CONTEXT, alarm: float = 0.05) -> DataFrame:
    """(inputs, truncated, rate, alarm): how many inputs an embedder cuts, and whether that is too many."""
    n = texts.agg(F.count(F.lit(1)).alias("inputs"), F.count_if(is_cut(F.col(text_col), context)).alias("truncated"))
    n = n.withColumn("rate", F.round(F.coalesce(F.try_divide("truncated", "inputs"), F.lit(0.0)), 6))
    return n.withColumn("alarm", F.col("rate") > alarm)


def state_digest(rows: DataFrame, *keys: str) -> DataFrame:
    """(n, digest) of a table's rows, whatever their order: equal before and after a measurement that changes nothing."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("digest"))


@dataclass(frozen=True)
class Health:
    overlap: float
    worst: float
    lost: int
    bloat: float


def index_problems(h: Health) -> list[str]:
    """Limits of a healthy index (fixed values)."""
    checks = (("overlap", h.overlap < 0.9), ("worst question", h.worst < 0.1), ("lost answers", h.lost > 0), ("bloat", h.bloat > 2))
    return [name for name, bad in checks if bad]


# Thresholds of the acceptance gate.
GATE = {"recall_5": 0.40, "wilson_5": 0.33, "recall_10": 0.48, "missing_50": 0.45}


def acceptance(ranks: DataFrame) -> DataFrame:
    """One row: recalls, Wilson bound at 5, missing at 50, MRR at 10 and 50, and whether the gate is passed."""
    at = {d: F.avg(F.coalesce(F.col("rank") <= d, F.lit(False)).cast("double")) for d in (1, 5, 10, 50)}
    mrr = {d: F.avg(F.when(F.col("rank") <= d, F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0))) for d in (10, 50)}
    hits5 = F.count_if(F.coalesce(F.col("rank") <= 5, F.lit(False)))
    n = F.count(F.lit(1))
    row = ranks.agg(n.alias("queries"), *(F.round(v, 6).alias(f"recall_{d}") for d, v in at.items()), F.round(wilson_lower(hits5, n), 6).alias("wilson_5"), F.round(1 - at[50], 6).alias("missing_50"), *(F.round(v, 6).alias(f"mrr_{d}") for d, v in mrr.items()))
    ok = (F.col("recall_5") >= GATE["recall_5"]) & (F.col("wilson_5") >= GATE["wilson_5"]) & (F.col("recall_10") >= GATE["recall_10"]) & (F.col("missing_50") <= GATE["missing_50"])
    return row.withColumn("accepted", ok)


def settings_digest(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def dataset_digest(golden: list[tuple[str, list[str]]]) -> str:
    return hashlib.sha256("\n".join(f"{q}\0{chr(1).join(expect)}" for q, expect in golden).encode()).hexdigest()
