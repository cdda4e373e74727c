"""Full-text search deals documents in parts of bounded size and moves no scores."""

from __future__ import annotations

import re

from lodestone.operators import lexical


def test_scores_stay_with_their_documents(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id AS query_id", "text")
    got = lexical.search(docs, asked, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"hashpartitioning\(([^)]*)", plan)
    assert not [m for m in moved if re.search(r"query_id.*doc_id|doc_id.*term", m)]
    few = sorted(got.collect())
    before = lexical._tasks(docs)
    monkeypatch.setattr(lexical, "SHARE", 20_000)
    # the file has about 290 kB
    assert 14 <= lexical._tasks(docs) <= 16 > before
    assert sorted(lexical.search(docs, asked, 5).collect()) == few
    assert lexical._tasks(spark.createDataFrame([(1, "a")], "doc_id long, text string")) == spark.sparkContext.defaultParallelism
