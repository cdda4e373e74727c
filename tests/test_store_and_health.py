"""Snapshots that readers and crashes cannot break, index health, reranking that fails, and kNN within a group."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.operators import evaluate, fusion, knn
from lodestone.plans import search as plans
from lodestone.sources import files, models


def one(spark, x):
    return spark.createDataFrame([(x,)], "a int")


def test_a_commit_never_hides_the_store(spark, tmp_path):
    s = files.Snapshots(spark, f"file://{tmp_path}/t")
    s.commit({"x": one(spark, 1)})
    # a crash after the pointer was created and before it was written
    (tmp_path / "t" / "CURRENT-000000000002").write_text('{"version": 1, "tab')
    assert s.read("x", "a int").first().a == 1
    s.commit({"x": one(spark, 2)})
    assert s.read("x", "a int").first().a == 2 and (tmp_path / "t" / "CURRENT-000000000003").exists()
    assert not s._point(3, {})
    s.vacuum()
    assert s.read("x", "a int").first().a == 2


def test_two_commits_at_once(spark, tmp_path, monkeypatch):
    a, b = (files.Snapshots(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.commit({"x": one(spark, 1), "y": one(spark, 1)})
    real, done = files.Snapshots._point, []

    def late(self, n, tables):
        if self is a and not done:
            done.append(b.commit({"y": one(spark, 7)}))
        return real(self, n, tables)

    monkeypatch.setattr(files.Snapshots, "_point", late)
    a.commit({"x": one(spark, 5)})
    assert a.read("x", "a int").first().a == 5 and a.read("y", "a int").first().a == 7
    done.clear()
    with pytest.raises(files.Conflict):
        a.commit({"y": one(spark, 9)})
    assert a.read("y", "a int").first().a == 7


def test_a_newer_store_is_refused(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "CURRENT-000000000001").write_text('{"version": 99, "tables": {}}')
    with pytest.raises(RuntimeError, match="version 99"):
        files.Snapshots(spark, f"file://{tmp_path}/t").tables()


def test_lost_answers_and_bloat(spark):
    exact = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True), (3, 4, False), (4, 5, None)], "query_id long, id long, good boolean")
    got = {r.query_id: r.lost for r in evaluate.lost_answers(exact, exact.where("id IN (2, 3)"), F.col("good")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "content_hash string")
    assert tuple(evaluate.bloat(chunks, chunks.limit(1).unionByName(chunks.limit(1))).first()) == (3, 1, 3.0)
    assert tuple(evaluate.bloat(chunks.limit(0), chunks).first()) == (0, 0, 0.0)
    assert evaluate.index_problems(evaluate.Health(0.0, 0.0, 1, 3.0)) == ["overlap", "worst question", "lost answers", "bloat"]


def test_reranking_in_batches_that_may_fail(spark):
    class Model:
        def score(self, query, documents):
            if query == "bad" or len(documents) > 16:
                raise OSError("no model")
            return [float(len(d)) for d in documents]

    rows = spark.createDataFrame([(q, i, i + 1, "bad" if q == 2 else "good", "x" * i) for q in (1, 2) for i in range(20)], "query_id long, id long, pos int, question string, embed_text string")
    got = models.rerank_scores(rows, Model()).collect()
    assert len(got) == 40 and all(r.ce is None if r.query_id == 2 else r.ce == r.id for r in got)
    with pytest.raises(Exception, match="no model"):
        models.rerank_scores(rows, Model(), strict=True).collect()


def test_strict_search_needs_scores(spark):
    q = spark.createDataFrame([(1, "word", None)], "query_id long, text string, vector array<double>")
    loc = spark.createDataFrame([(1, "a.ts", "function", "f", "typescript", 1)], "id long, path string, kind string, symbol string, lang string, start_line int")
    texts, v = spark.createDataFrame([(1, "word")], "id long, text string"), spark.createDataFrame([], "id long, embedding array<double>")
    assert plans.search(q, v, loc, texts, mode="lexical").count() == 1
    with pytest.raises(fusion.RerankUnavailable):
        plans.search(q, v, loc, texts, config.Search(rerank=config.Rerank(strict=True)), mode="lexical")


def test_written_postings_give_the_same_list(spark):
    from lodestone.operators import lexical

    docs = spark.createDataFrame([(1, "getUserName of the user"), (2, "plain user words user"), (3, None), (4, "HTTPServer user_name")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "user name"), (2, "HTTPServer")], "query_id long, text string")
    index = lexical.postings(docs, "doc_id", "text")
    assert sorted(lexical.search(docs, asked, 5).collect()) == sorted(lexical.search_postings(index, asked, 5).collect())
    # text without a seam counts its words twice, as it is and apart
    assert {(r.doc_id, r.term): r.tf for r in index.collect()}[2, "user"] == 4


def test_nearest_of_the_same_group(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 3 if i else None) for i in range(12)], "vec_id long, embedding array<double>, label int")
    q = v.selectExpr("vec_id AS query_id", "embedding AS vector", "label")
    got = knn.top_k(v, q, 20, same=("label", "label")).collect()
    assert len(got) == sum(n * n for n in (3, 4, 4)) and all(r.query_id % 3 == r.vec_id % 3 for r in got)
