"""Rank fusion, priors, reranking, diversification and sweeps over ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Penalty, Search
from lodestone.functions.text import glob_regex


def rrf(ranks: DataFrame, weights: dict[str, float], k: int = 60, depth: int | None = None, id_col: str = "id", branch_col: str = "branch") -> DataFrame:
    """(query_id, branch, id, rank) -> (query_id, id, score, branches): sum of weight / (k + rank)."""
    rows = ranks if depth is None else ranks.where(F.col("rank") <= depth)
    weight = F.coalesce(*(F.when(F.col(branch_col) == b, F.lit(float(w))) for b, w in weights.items()))
    part = weight / (F.lit(float(k)) + F.col("rank"))
    return rows.where(weight.isNotNull()).groupBy("query_id", id_col).agg(F.round(F.sum(part), 9).alias("score"), F.array_sort(F.collect_set(branch_col)).alias("branches"))


def hybrid(vec: DataFrame, lex: DataFrame, s: Search, id_col: str = "id") -> DataFrame:
    """The two-branch fusion: score, in_vec, in_lex, dist (null if no vector list has the row); the best max(6 k, 60) of a question."""
    dist = F.col("dist") if "dist" in vec.columns else F.lit(None).cast("double").alias("dist")
    both = vec.select("query_id", id_col, "rank", F.lit("vec").alias("branch"), dist).unionByName(lex.select("query_id", id_col, "rank", F.lit("lex").alias("branch"), F.lit(None).cast("double").alias("dist")))
    part = F.when(F.col("branch") == "vec", F.lit(s.vector_weight)).otherwise(F.lit(s.lexical_weight)) / (F.lit(float(s.rrf_k)) + F.col("rank"))
    fused = both.groupBy("query_id", id_col).agg(F.round(F.sum(part), 9).alias("score"), F.bool_or(F.col("branch") == "vec").alias("in_vec"), F.bool_or(F.col("branch") == "lex").alias("in_lex"), F.max("dist").alias("dist"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return fused.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max(6 * s.top_k, 60))


def via(in_vec: Column, in_lex: Column) -> Column:
    return F.when(in_vec & in_lex, "both").when(in_vec, "vector").otherwise("lexical")


def prior(path: Column, kind: Column, symbol: Column, lang: Column, s: Search, penalties: Sequence[Penalty] | None = None) -> Column:
    """Product of the priors that apply; never above 1."""
    out = F.when(kind == "file_card", F.lit(s.file_card_prior)).otherwise(F.lit(1.0))
    out = out * F.when(kind.isin("binding", "preamble") & symbol.isNull(), F.lit(s.unnamed_prior)).otherwise(F.lit(1.0))
    out = out * F.when(path.startswith("@deleted/"), F.lit(s.deleted_prior)).otherwise(F.lit(1.0))
    out = out * F.when(lang.isin("markdown", "mdx"), F.lit(s.doc_prior)).otherwise(F.lit(1.0))
    for p in s.penalties if penalties is None else penalties:
        out = out * F.when(path.rlike(glob_regex(p.glob)), F.lit(p.weight)).otherwise(F.lit(1.0))
    return out


def resort(rows: DataFrame, score_col: str = "score", pos_col: str = "pos") -> DataFrame:
    """Positions anew by falling score; equal scores keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score_col), pos_col)
    return rows.withColumn("__p", F.row_number().over(w)).drop(pos_col).withColumnRenamed("__p", pos_col)


class RerankUnavailable(RuntimeError):
    """Strict reranking was asked for and the scores are missing."""


def rerank(rows: DataFrame, scores: DataFrame | None, s: Search, id_col: str = "id") -> DataFrame:
    """Rerank the head by (query_id, id, ce) scores; the tail follows in its old order.

    Fusion rrf gives 1 / (k + position) + weight / (k + rank by ce x prior); replace sorts the head by
    ce x prior alone. Without scores the old order stays, or it is an error when strict.
    """
    r = s.rerank
    if scores is None:
        if r.strict:
            raise RerankUnavailable
        return rows
    joined = rows.join(scores.select("query_id", id_col, "ce"), ["query_id", id_col], "left").withColumn("is_head", F.col("pos") <= r.candidates)
    weighed = F.coalesce("ce", F.lit(0.0)) * F.col("prior")
    by_ce = Window.partitionBy("query_id", "is_head").orderBy(F.desc(F.round(weighed, 9)), "pos")
    ranked = joined.withColumn("ce_rank", F.row_number().over(by_ce))
    k = F.lit(float(s.rrf_k))
    head = F.lit(1.0) / (k + F.col("pos")) + F.lit(r.weight) / (k + F.col("ce_rank")) if r.fusion == "rrf" else weighed
    new = ranked.withColumn("score", F.when(F.col("is_head"), F.round(head, 9)).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("is_head"), F.when(F.col("is_head"), -F.col("score")), "pos")
    return new.withColumn("__p", F.row_number().over(w)).drop("pos", "is_head", "ce_rank").withColumnRenamed("__p", "pos")


def diversify(rows: DataFrame, k: int, per_file: int, path_col: str = "path") -> DataFrame:
    """At most ``per_file`` rows of a path, refilled from the rest in order when fewer than k are left."""
    n = F.row_number().over(Window.partitionBy("query_id", path_col).orderBy("pos"))
    marked = rows.withColumn("__over", n > per_file)
    w = Window.partitionBy("query_id").orderBy("__over", "pos")
    return marked.withColumn("__p", F.row_number().over(w)).where(F.col("__p") <= k).drop("pos", "__over").withColumnRenamed("__p", "pos")


def judge(rows: DataFrame, verdicts: DataFrame, weight: float = 2.0, k: int = 60, id_col: str = "id") -> DataFrame:
    """A judge's ranks add weight / (k + judge_rank); rows it did not see get no bonus."""
    out = rows.join(verdicts.select("query_id", id_col, "judge_rank"), ["query_id", id_col], "left")
    bonus = F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + F.col("judge_rank")), F.lit(0.0))
    return resort(out.withColumn("score", F.round(F.lit(1.0) / (F.lit(float(k)) + F.col("pos")) + bonus, 9)))


def cascade(rows: DataFrame, picked: Column, head: int = 15, batch: int = 30, promote_only: bool = True) -> DataFrame:
    """Batched judging: rows a judge picked move to the front of the head (or alone stay), in order.

    ``batch_no`` is the batch of a row. Promote-only never drops a row.
    """
    marked = rows.withColumn("batch_no", F.floor((F.col("pos") - 1) / batch).cast("int")).withColumn("__pick", F.coalesce(picked, F.lit(False)))
    first = Window.partitionBy("query_id", "__pick").orderBy("pos")
    marked = marked.withColumn("__front", F.col("__pick") & (F.row_number().over(first) <= head))
    kept = marked if promote_only else marked.where("__pick")
    w = Window.partitionBy("query_id").orderBy(F.desc("__front"), "pos")
    return kept.withColumn("__p", F.row_number().over(w)).drop("pos", "__pick", "__front").withColumnRenamed("__p", "pos")


def subsets(ranks: DataFrame, branches: Sequence[str], depth: int = 50, k: int = 60, id_col: str = "id") -> DataFrame:
    """Fusion of every non-empty subset of branches in one job: (mask, query_id, id, score)."""
    masks = F.array(*(F.lit(m) for m in range(1, 1 << len(branches))))
    bit = F.coalesce(*(F.when(F.col("branch") == b, F.lit(1 << i)) for i, b in enumerate(branches)))
    rows = ranks.where(F.col("rank") <= depth).withColumn("bit", bit).where("bit IS NOT NULL").withColumn("mask", F.explode(F.filter(masks, lambda m: m.bitwiseAND(F.col("bit")) != 0)))
    return rows.groupBy("mask", "query_id", id_col).agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))


def rerank_sweep(rows: DataFrame, scores: DataFrame, depths: Sequence[int], weights: Sequence[float], k: int = 60, top: int = 5, id_col: str = "id") -> DataFrame:
    """Rank fusion at every depth and weight in one job: (depth, weight, query_id, id, pos) of the first rows."""
    params = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(float(w)).alias("weight")) for d in depths for w in weights)))
    joined = rows.join(scores.select("query_id", id_col, "ce"), ["query_id", id_col], "left").select("*", params.alias("p")).select("*", "p.depth", "p.weight").drop("p")
    head = joined.where(F.col("pos") <= F.col("depth"))
    keys = ["depth", "weight", "query_id"]
    ce_rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(F.coalesce("ce", F.lit(0.0)) * F.col("prior"), 9)), "pos"))
    scored = head.withColumn("new", F.round(F.lit(1.0) / (F.lit(float(k)) + F.col("pos")) + F.col("weight") / (F.lit(float(k)) + ce_rank), 9))
    ranked = scored.withColumn("new_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("new"), "pos")))
    return ranked.where(F.col("new_pos") <= top).select(*keys, id_col, F.col("new_pos").cast("int").alias("pos"))


def two_views(rows: DataFrame, a: str, b: str, k: int = 60, id_col: str = "id") -> DataFrame:
    """Ranks of rows by two similarities (such as code and description), by the larger one, and by RRF."""
    by = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), id_col))
    ranked = rows.withColumn("best", F.greatest(a, b)).withColumns({"rank_a": by(a), "rank_b": by(b), "rank_max": by("best")})
    ranked = ranked.withColumn("rrf", F.round(F.lit(1.0) / (F.lit(float(k)) + F.col("rank_a")) + F.lit(1.0) / (F.lit(float(k)) + F.col("rank_b")), 9))
    return ranked.withColumn("rank_rrf", by("rrf")).select("query_id", id_col, *(F.col(c).cast("int").alias(c) for c in ("rank_a", "rank_b", "rank_max", "rank_rrf")))


def pool(ranks: DataFrame, expected: DataFrame, depth: int = 40, k: int = 60, id_col: str = "id") -> DataFrame:
    """Distinct candidates worth describing: the first fused rows of every question, and all expected ones."""
    fused = ranks.groupBy("query_id", id_col).agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))
    first = fused.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))).where(F.col("n") <= depth)
    return first.select(id_col).unionByName(expected.select(id_col)).distinct()
