"""The corpus pipeline: select, deduplicate, decontaminate, redact and tokenize ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again
as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, near_copies, piece_bpe, quality, secrets_scan
from lodestone.llm._common import table, written


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose tail probability of the top grade is at least one half."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are linked by a similarity of 0.8 or more."""
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their text replaced by a mark."""
    return secrets_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the text they decode to."""
    return piece_bpe.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")[0]
    return docs


#: Models and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
