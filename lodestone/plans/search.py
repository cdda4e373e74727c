"""Whole searches as one lazy plan over many questions: branches, fusion, priors, rerank, diversify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Search
from lodestone.operators import fusion, knn, lexical, maintain


def search(questions: DataFrame, vectors: DataFrame, locations: DataFrame, texts: DataFrame, s: Search | None = None, mode: str | None = None, where: Column | None = None, scores: DataFrame | None = None, factor: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Ranked locations for every question: query_id, pos, id, path, score, sim, via and location columns.

    questions(query_id, text, vector); vectors(id, embedding); locations(id, path, kind, symbol, lang,
    start_line, ...); texts(id, text). ``factor(id, factor)`` lowers scores further; ``scores`` are a
    reranker's (query_id, id, ce). With written ``postings(id, term, tf)`` no text is read. Wide columns are
    joined to the ranked rows only.

    With reranking enabled and no scores the order stays as it is, or, if it is strict, that is an error.
    """
    s = s or Search()
    mode = mode or s.mode
    live = locations if s.include_deleted else locations.where(~F.col("path").startswith(maintain.HISTORY))
    if where is not None:
        live = live.where(where)
    ids = live.select("id").distinct()
    vec = lex = None
    if mode in ("semantic", "hybrid"):
        vec = knn.top_k(vectors.join(ids, "id", "left_semi"), questions, s.candidates, id_col="id")
    if mode in ("lexical", "hybrid"):
        if postings is not None:
            lex = lexical.search_postings(postings, questions, s.candidates, id_col="id", live=ids)
        else:
            lex = lexical.search(texts, questions, s.candidates, id_col="id", live=ids)
    empty = (vec if vec is not None else lex).select("query_id", "id", "rank").limit(0)
    fused = fusion.hybrid(vec if vec is not None else empty, lex if lex is not None else empty, s)
    # the distance comes along, so the vector scan runs once
    rows = fused.join(live, "id").withColumn("sim", F.round(1 - F.col("dist"), 6)).drop("dist")
    p = fusion.prior(F.col("path"), F.col("kind"), F.col("symbol"), F.col("lang"), s)
    if factor is not None:
        rows = rows.join(factor, "id", "left")
        p = p * F.least(F.coalesce("factor", F.lit(1.0)), F.lit(1.0))
    rows = rows.withColumn("prior", p).withColumn("score", F.round(F.col("score") * F.col("prior"), 9)).withColumn("via", fusion.via(F.col("in_vec"), F.col("in_lex")))
    rows = fusion.resort(rows)
    if s.rerank.enabled:
        rows = fusion.rerank(rows, scores, s)
    return fusion.diversify(rows, s.top_k, s.max_per_file)


def find_similar(anchors: DataFrame, vectors: DataFrame, locations: DataFrame, k: int, exclude_same_file: bool = True, include_deleted: bool = False) -> DataFrame:
    """Neighbours of the chunk at (query_id, path, line): never the anchor itself, nor (by default) its file.

    The anchor is the smallest chunk of the path that covers the line. An anchor without one gives no row.
    """
    from pyspark.sql import Window

    at = anchors.join(locations.select("id", "path", "start_line", "end_line"), "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    w = Window.partitionBy("query_id").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id")
    anchor = at.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", F.col("id").alias("anchor"), F.col("path").alias("anchor_path"))
    asked = anchor.join(vectors.select(F.col("id").alias("anchor"), F.col("embedding").alias("vector")), "anchor")
    live = locations if include_deleted else locations.where(~F.col("path").startswith(maintain.HISTORY))
    kept = vectors.join(live.select("id", "path"), "id")
    near = knn.top_k(kept, asked, k + 1, id_col="id", exclude=("path", "anchor_path") if exclude_same_file else ("id", "anchor")).drop("rank")
    rows = near.join(live, "id").join(anchor, "query_id").where(F.col("id") != F.col("anchor"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "path", "start_line", "id")))
    return ranked.where(F.col("rank") <= k).withColumn("sim", F.round(1 - F.col("dist"), 6)).drop("anchor", "anchor_path")
