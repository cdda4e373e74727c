"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_llm_operators import brute_contamination
from test_near_copies import brute_kept

from lodestone.llm import secrets_scan
from lodestone.llm.queries import QUERIES


def test_stages(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "decontaminate", "secrets", "tokenize"]
    now = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame(list(now.values()), docs.schema)
        out = stage(spark, frame, sf).collect()
        new = {r.doc_id: r for r in out}
        assert len(out) == len(new)
        if name != "tokenize":
            assert out[0].__fields__ == docs.columns
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
            assert good <= set(new) and len(bad & set(new)) <= 0.2 * len(bad) + 1
        elif name == "near_copies":
            # five words and a similarity of 0.8: the stage's contract, not op8's
            assert set(new) == brute_kept([(k, r.text) for k, r in now.items()])
        elif name == "decontaminate":
            leaks = {d for d, _ in brute_contamination([(k, r.text) for k, r in now.items()], items)}
            assert set(new) == set(now) - leaks
        elif name == "secrets":
            assert set(new) == set(now)
            assert all(new[k].text == secrets_scan.redacted(now[k].text) and new[k].n_chars == len(new[k].text) for k in now)
            assert not any(secrets_scan.base_spans(r.text, r.text.lower()) for r in new.values())
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert set(new) == set(now) and all(new[k].ids == lib.encode(now[k].text) and new[k].decoded == lib.decode(new[k].ids) for k in now)
        now = new


def test_run_and_empty(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
    none = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", None), (1, "", "en", "s", 0)], none.schema)
    kept = odd
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
    assert kept.count() >= 1


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert F is not None
