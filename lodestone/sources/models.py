"""Pluggable models: embedders and rerankers as small protocols, run over Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model_id: str
    dims: int

    def embed(self, texts: Sequence[str], kind: str) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, documents: Sequence[str]) -> list[float]: ...


class HashingEmbedder:
    """Deterministic feature hashing of words at unit length; for tests and demonstrations."""

    def __init__(self, dims: int = 64):
        self.dims, self.model_id = dims, f"hashing-{dims}+ws"

    def embed(self, texts: Sequence[str], kind: str) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


class OverlapReranker:
    """Share of the query's words that a document has, as a probability."""

    def score(self, query: str, documents: Sequence[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [1 / (1 + math.exp(-(4 * len(q & set(re.findall(r"\w+", d.lower()))) / len(q) - 2))) if q else 0.5 for d in documents]


def _halving(model: Embedder, texts: list[str], kind: str, levels: int = 2) -> list[list[float]]:
    """A failed batch is tried again in halves, twice; then the error stands."""
    try:
        got = model.embed(texts, kind)
        if len(got) != len(texts) or any(len(v) != model.dims for v in got):
            raise ValueError("the model returned another number or length of vectors")
        return got
    except Exception:
        if not levels or len(texts) < 2:
            raise
        half = len(texts) // 2
        return _halving(model, texts[:half], kind, levels - 1) + _halving(model, texts[half:], kind, levels - 1)


def embed(rows: DataFrame, model: Embedder, kind: str = "document", text_col: str = "embed_text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with a vector for each text; texts of like length share a batch."""
    ordered = rows.sortWithinPartitions(F.length(text_col))
    schema = rows.withColumn(out, F.array().cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            vectors = [v for at in range(0, len(texts), batch) for v in _halving(model, texts[at : at + batch], kind)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    return ordered.mapInArrow(run, schema)


def rerank_scores(rows: DataFrame, model: Reranker, head: int = 20, text_col: str = "embed_text", batch: int = 16, strict: bool = False) -> DataFrame:
    """(query_id, id, ce) for the first rows of each question; rows carry question and pos.

    A question's rows are scored ``batch`` at a time. If the model fails, their ce is null, which leaves
    their order as it was; or, if ``strict``, that is an error.
    """
    some = rows.where(F.col("pos") <= head).select("query_id", "id", "question", F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, texts = [q or "" for q in b.column("question").to_pylist()], [t or "" for t in b.column("t").to_pylist()]
            scores: list[float | None] = []
            while (at := len(scores)) < len(texts):
                end = at + 1
                while end < min(len(texts), at + batch) and asked[end] == asked[at]:
                    end += 1
                try:
                    got = [float(x) for x in model.score(asked[at], texts[at:end])]
                    if len(got) != end - at:
                        raise ValueError("the model returned another number of scores")
                except Exception:
                    if strict:
                        raise
                    got = [None] * (end - at)
                scores += got
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(scores, pa.float64())], names=["query_id", "id", "ce"])

    kind = dict(rows.dtypes)
    return some.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, f"query_id {kind['query_id']}, id {kind['id']}, ce double")
