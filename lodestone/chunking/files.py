"""Chunking of whole file tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.chunking import code, markdown
from lodestone.config import Budget
from lodestone.functions.text import content_hash, lang_for

SCHEMA = "repo string, path string, embed_text string, raw_text string, start_line int, end_line int, symbol string, kind string, parent_chain array<string>, exported boolean, token_count int"
_ARROW = pa.schema([("repo", pa.string()), ("path", pa.string()), ("embed_text", pa.string()), ("raw_text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("kind", pa.string()), ("parent_chain", pa.list_(pa.string())), ("exported", pa.bool_()), ("token_count", pa.int32())])


def chunk_files(files: DataFrame, model_id: str = "none", budget: Budget | None = None, callers: DataFrame | None = None) -> DataFrame:
    """(repo, path, text) -> chunks with content hash, body hash and language.

    ``callers(callee, callers)`` is used only when the budget asks for caller lines; it is joined to the
    names each file mentions, so no map of the whole corpus is sent anywhere.
    """
    b = budget or Budget()
    rows = files.select("repo", "path", F.coalesce("text", F.lit("")).alias("text"))
    if callers is not None and b.callers:
        names = rows.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), 0))).alias("callee"))
        mine = names.join(callers, "callee").groupBy("repo", "path").agg(F.collect_list(F.struct("callee", "callers")).alias("called"))
        rows = rows.join(mine, ["repo", "path"], "left")
    else:
        rows = rows.withColumn("called", F.lit(None).cast("array<struct<callee:string,callers:array<string>>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"].lower().endswith((".md", ".mdx", ".markdown")):
                    made = markdown.chunk(r["repo"], r["path"], r["text"], b)
                else:
                    made = code.chunk(r["repo"], r["path"], r["text"], b, {c["callee"]: c["callers"] for c in r["called"] or []})
                yield pa.RecordBatch.from_pylist([{"repo": r["repo"], **c} for c in made], schema=_ARROW)

    out = rows.mapInArrow(run, SCHEMA)
    return out.withColumns({"content_hash": content_hash(F.lit(model_id), F.col("embed_text")), "body_hash": F.sha2("raw_text", 256), "lang": lang_for(F.col("path"))})


def call_map(files: DataFrame) -> DataFrame:
    """(callee, callers): up to three calling names, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for r in batch.to_pylist() for c in code.calls(r["path"], r["text"] or "")]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], names=["callee", "caller"])

    pairs = files.select("path", "text").mapInArrow(run, "callee string, caller string")
    return pairs.groupBy("callee").agg(F.slice(F.array_sort(F.collect_set("caller")), 1, code.MOST_CALLERS).alias("callers"))
