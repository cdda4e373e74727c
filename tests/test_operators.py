"""Rules of the retrieval operators that the tables do not exercise."""

from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import evaluate, fusion, knn, maintain, present
from lodestone.plans import search as plans
from lodestone.sources import files, models
from lodestone.streaming import queue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_code_query_terms(spark):
    assert sorted(one(spark, T.code_query(F.lit("HTTPServer retry_count a б")))) == ["count", "http", "httpserver", "retry", "server"]
    assert one(spark, T.code_query(F.lit("где это"))) == []


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(T.glob_regex(g), p))
    assert hit("**/*.test.*", "a.test.ts") and hit("**/test/**", "test/a.ts") and hit("**/.env", "x/.env") and not hit("**/*.key", "a.keys") and not hit("**/dist/**", "distance/a")


def test_admission(spark):
    rows = spark.createDataFrame([(p,) for p in ("a.ts", "x/.env", "node_modules/a.js", "a.d.ts", "b.MD", "CHANGELOG.md", "a.py", "secrets/k.ts", "a.min.js")], "path string")
    assert sorted(r.path for r in rows.where(files.admitted(F.col("path"))).collect()) == ["a.ts", "b.MD"]
    assert one(spark, files.refusal(F.lit("a\0b"), F.lit(3), F.lit("a.ts"))) == "binary"
    assert one(spark, files.refusal(F.lit("x" * 300), F.lit(300), F.lit("a.ts"))) == "minified"
    assert one(spark, files.refusal(F.lit("x" * 300), F.lit(300), F.lit("a.md"))) is None


def test_priors_only_lower(spark):
    s = config.Search()
    p = lambda path, kind="function", symbol="s", lang="typescript": one(spark, F.round(fusion.prior(F.lit(path), F.lit(kind), F.lit(symbol), F.lit(lang), s), 6))
    assert p("src/a.ts") == 1 and p("src/a.test.ts") == 0.4 and p("a.ts", "file_card") == 0.6 and p("src/x.test.ts", "file_card") == 0.24
    assert p("@deleted/a.ts") == 0.5 and p("a.md", lang="markdown") == 0.7 and p("a.ts", "binding", None) == 0.7


def test_vectors(spark):
    assert one(spark, V.normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.truncate(F.array(*map(F.lit, (3.0, 4.0, 9.0))), 2)) == [0.6, 0.8]
    with pytest.raises(Exception, match="shorter"):
        one(spark, V.truncate(F.array(F.lit(1.0)), 2))
    with pytest.raises(ValueError):
        T.model_input(F.lit("x"), "unknown", "query")


def test_knn_in_batches_and_exclusion(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0], i % 2) for i in range(40)] + [(None, [1.0, 1.0], 0), (99, None, 0)], "id long, embedding array<double>, g int")
    q = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(5)] + [(9, None, 0)], "query_id long, vector array<double>, h int")
    whole = sorted(map(tuple, knn.top_k(v, q, 3, id_col="id").collect()))
    monkeypatch.setattr(knn, "BATCH", 2)
    assert sorted(map(tuple, knn.top_k(v, q, 3, id_col="id").collect())) == whole and len(whole) == 15
    apart = knn.top_k(v, q, 40, id_col="id", exclude=("g", "h")).collect()
    assert len(apart) == 100 and all(r.id % 2 != r.query_id % 2 for r in apart)
    assert knn.top_k(v, q.limit(0), 3, id_col="id").count() == 0


def test_diversify_refills(spark):
    rows = spark.createDataFrame([(1, i, "a" if i < 6 else "b") for i in range(1, 8)], "query_id int, pos int, path string")
    got = [(r.path, r.pos) for r in fusion.diversify(rows, 6, 2).orderBy("pos").collect()]
    assert [p for p, _ in got] == ["a", "a", "b", "b", "a", "a"]


def test_rerank_without_scores(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1.0, 1.0)], "query_id int, id int, pos int, score double, prior double")
    assert fusion.rerank(rows, None, config.Search()) is rows
    with pytest.raises(fusion.RerankUnavailable):
        fusion.rerank(rows, None, config.Search(rerank=config.Rerank(strict=True)))


def test_search_modes_and_filters(spark):
    model = models.HashingEmbedder(16)
    texts = [(1, "retry payment queue"), (2, "render the form"), (3, "payment form"), (4, "old payment code")]
    t = spark.createDataFrame(texts, "id long, text string")
    v = models.embed(t, model, text_col="text").select("id", "embedding")
    loc = spark.createDataFrame([(1, "src/a.ts"), (2, "src/b.ts"), (3, "src/b.test.ts"), (4, "@deleted/c.ts")], "id long, path string").selectExpr("*", "'function' AS kind", "'s' AS symbol", "'typescript' AS lang", "1 AS start_line")
    q = models.embed(spark.createDataFrame([(7, "payment queue")], "query_id long, text string"), model, "query", "text").withColumnRenamed("embedding", "vector")
    best = plans.search(q, v, loc, t, mode="hybrid").orderBy("pos").collect()
    assert best[0].id == 1 and best[0].via == "both" and 4 not in {r.id for r in best}
    words = plans.search(q, v, loc, t, mode="lexical").collect()
    assert {r.id for r in words} == {1, 3} and all(r.sim is None for r in words)
    assert {r.id for r in plans.search(q, v, loc, t, mode="hybrid", where=F.col("path").like("src/b%")).collect()} == {2, 3}
    old = plans.search(q, v, loc, t, config.Search(include_deleted=True), mode="semantic").collect()
    assert 4 in {r.id for r in old}
    ce = models.rerank_scores(plans.search(q, v, loc, t, mode="hybrid").join(t, "id").withColumn("question", F.lit("render form")), models.OverlapReranker(), text_col="text")
    again = plans.search(q, v, loc, t, config.Search(rerank=config.Rerank(fusion="replace")), mode="hybrid", scores=ce).orderBy("pos").first()
    assert again.id == 2


def test_embedding_is_tried_again_in_halves(spark):
    class Frail(models.HashingEmbedder):
        def embed(self, texts, kind):
            if len(texts) > 20:
                raise RuntimeError("too many")
            return super().embed(texts, kind)

    assert len(models._halving(Frail(4), ["a"] * 64, "document")) == 64
    with pytest.raises(RuntimeError):
        models._halving(Frail(4), ["a"] * 200, "document")


def test_wilson_and_gate(spark):
    bound = lambda h, n: one(spark, evaluate.wilson_lower(F.lit(float(h)), F.lit(float(n))))
    assert bound(43, 100) >= 0.33 > bound(42, 100) and bound(0, 0) == 0
    assert evaluate.sign_test(5, 0) == 0.0625 and evaluate.sign_test(0, 0) == 1
    assert evaluate.index_problems(evaluate.Health(0.95, 0.5, 0, 1.2)) == [] and len(evaluate.index_problems(evaluate.Health(0.5, 0.05, 2, 3))) == 4
    good = spark.createDataFrame([(i, 1 if i < 60 else None) for i in range(100)], "query_id int, rank int")
    assert evaluate.acceptance(good).first().accepted and not evaluate.acceptance(good.where("query_id > 50")).first().accepted


def test_match_keys(spark):
    got = one(spark, evaluate.match_keys(F.lit("a.ts"), F.lit("x, y"), F.array(F.lit("K"))))
    assert got == ["a.ts", "a.ts::x", "a.ts::y", "a.ts::K"]


def test_nearest_ranks(spark):
    rows = spark.createDataFrame([(float(i % 50),) for i in range(500)] + [(None,)], "v double")
    got = evaluate.nearest_ranks(rows, "v", {"p50": 0.5, "p95": 0.95}).first()
    values = sorted(float(i % 50) for i in range(500))
    assert (got.p50, got.p95) == (values[250], values[475])


def test_map_packing_keeps_the_budget(spark):
    rows = spark.createDataFrame([(f"dir{i:03d}", 400 - i, [f"symbol{j}" for j in range(30)]) for i in range(400)], "dir string, files long, symbols array<string>")
    kept = present.pack_map(rows, 1500).where("kept").collect()
    assert 0 < len(kept) < 400 and sum(-(-len(r.block) * 10 // 32) for r in kept) <= 1500 * 1.05
    one_dir = present.pack_map(rows.limit(1), 1).collect()
    assert one_dir[0].kept


def test_formatting():
    hit = dict(path="a.ts", start_line=1, end_line=40, symbol="f", kind="function", parent_chain=["K"], raw_text="\n".join(f"line {i}" for i in range(40)), sim=0.5)
    text = present.format_hits([hit, {**hit, "sim": 0.9}])
    assert "... 26 lines" in text and "K > f" in text and "Note: the order" in text
    assert present.format_hits([hit] * 50, 60).count("a.ts") == 1


def test_incremental(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("@deleted/z", "9")], "path string, sha string")
    now = spark.createDataFrame([("a", "1"), ("c", "3")], "path string, sha string")
    assert {r.path: r.status for r in maintain.changed(now, known).collect()} == {"a": "same", "c": "new"}
    assert [r.path for r in maintain.removed(now, known).collect()] == ["b"]
    spans = spark.createDataFrame([("p", 1, 50, "x"), ("p", 10, 12, "y"), ("q", 1, 5, "z")], "path string, start_line int, end_line int, content_hash string")
    assert [r.content_hash for r in maintain.nearest_below(spans, 11).collect()] == ["y"]


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.ts").write_text("const a = 1\n")
    (tmp_path / "b.ts").write_text("gone\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "b.ts").unlink()
    run("commit", "-qam", "two")
    (tmp_path / "new.md").write_text("# x\n")
    listed = {r.path: r.sha for r in files.manifest(spark, str(tmp_path)).collect()}
    assert set(listed) == {"a.ts", "new.md"}
    read = {r.path: r for r in files.read_tree(spark, str(tmp_path)).where(~F.col("path").startswith(".git/")).collect()}
    assert read["a.ts"].sha == listed["a.ts"] and read["new.md"].text == "# x\n"
    gone = files.deletions(spark, str(tmp_path)).collect()
    assert [g.path for g in gone] == ["b.ts"] and files.show_file(str(tmp_path), gone[0].ref, "b.ts") == "gone\n"
    assert files.head_commit(str(tmp_path)) and files.show_file(str(tmp_path), "HEAD", "none") is None


def test_golden_is_sealed(spark, tmp_path):
    (tmp_path / "golden.jsonl").write_text('// note\n{"q": "where", "expect": ["a.ts::f"]}\n\n')
    (tmp_path / "holdout.jsonl").write_text('{"q": "x", "expect": []}\n')
    assert files.golden(spark, str(tmp_path / "golden.jsonl")).first().expect == ["a.ts::f"]
    with pytest.raises(files.Sealed):
        files.golden(spark, str(tmp_path / "holdout.jsonl"))
    assert files.golden(spark, str(tmp_path / "holdout.jsonl"), unseal=True).count() == 1


def test_exchange_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("ab" * 32, "e", "r", 3, "m", [0.5, -1.25])], "content_hash string, embed_text string, raw_text string, token_count int, model_id string, embedding array<float>")
    files.write_exchange(maintain.export_rows(rows), str(tmp_path / "x"))
    back = maintain.import_rows(files.read_exchange(spark, str(tmp_path / "x")), rows.limit(0))
    assert back.first().asDict() == rows.first().asDict()
    assert maintain.import_rows(files.read_exchange(spark, str(tmp_path / "x")), rows).count() == 0


def test_snapshots(spark, tmp_path):
    s = files.Snapshots(spark, f"file://{tmp_path}/t")
    assert s.read("x", "a int").count() == 0
    s.commit({"x": spark.createDataFrame([(1,)], "a int"), "y": spark.createDataFrame([(7,)], "b int")})
    before = s.read("x", "a int")
    s.commit({"x": before.unionByName(spark.createDataFrame([(2,)], "a int"))})
    assert sorted(r.a for r in s.read("x", "a int").collect()) == [1, 2] and before.count() == 1
    assert s.read("y", "b int").first().b == 7
    assert s.vacuum() >= 1 and s.read("x", "a int").count() == 2


def test_watch_isolates_errors(spark, tmp_path):
    day = [("r", f"p{i}", f"2024-01-01 00:00:{i:02d}") for i in range(5)] + [("r", "q", "2024-01-01 02:00:00")]
    spark.createDataFrame(day, "repo string, path string, ts string").selectExpr("repo", "path", "CAST(ts AS timestamp) AS ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, path string, ts timestamp").parquet(str(tmp_path / "in"))
    seen, errors = [], []

    def flush(batch, n):
        seen.extend(batch.collect())
        raise RuntimeError("flush failed")

    queue.watch(stream, flush, str(tmp_path / "cp"), gap="5 seconds", most=3, on_error=errors.append).awaitTermination()
    assert [(r.paths, r.reason) for r in seen] == [(5, "overflow")] and errors


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"search": {"top_k": 3, "rerank": {"weight": 1.0}}}')
    c = config.load(str(tmp_path / "c.json"), {"LODESTONE_SEARCH_CANDIDATES": "70", "OTHER": "x"})
    assert (c.search.top_k, c.search.rerank.weight, c.search.candidates, c.search.rrf_k) == (3, 1.0, 70, 60)
    with pytest.raises(ValueError):
        config.load(None, {"LODESTONE_SEARCH_NOPE": "1"})
    assert evaluate.settings_digest({"b": 1, "a": {"d": 1, "c": 2}}) == evaluate.settings_digest({"a": {"c": 2, "d": 1}, "b": 1})
