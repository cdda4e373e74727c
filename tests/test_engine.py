"""The engine end to end over a small repository."""

from __future__ import annotations

import subprocess

import pytest

from lodestone.engine import Engine, NoSuchChunk
from lodestone.sources.models import HashingEmbedder, OverlapReranker


def test_engine(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "src/queue.ts").write_text("/** Retry the payment later. */\nexport function retryPayment(job) {\n  return schedule(job, backoff(job.count))\n}\n")
    (repo / "src/form.tsx").write_text("export function PaymentForm() {\n  return render('card number')\n}\n")
    (repo / "docs.md").write_text("# Billing\nHow invoices are sent to customers.\n")
    (repo / "old.ts").write_text("export function legacyExport() {\n  return writeCsv()\n}\n")
    (repo / ".env").write_text("TOKEN=1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    engine = Engine(spark, f"file://{tmp_path}/store", HashingEmbedder(32), OverlapReranker())
    engine.add_repo("shop", str(repo))
    first = engine.index_repo("shop")
    assert first["changed"] == 4 and first["new"] == first["chunks"] > 0
    again = engine.index_repo("shop")
    assert again["changed"] == 0 and again["new"] == 0
    hits = engine.search(["retry payment later"], "shop", mode="hybrid").orderBy("pos").collect()
    assert hits[0].path == "src/queue.ts" and "retryPayment" in hits[0].raw_text
    git("rm", "-q", "old.ts")
    git("commit", "-qm", "two")
    (repo / "src/form.tsx").write_text("export function PaymentForm() {\n  return render('bank account')\n}\n")
    third = engine.index_repo("shop", full=True)
    assert third["removed"] == 1 and third["reused"] > 0
    assert engine.gc() > 0
    assert engine.index_history("shop")["changed"] == 1
    seen = lambda **how: {h.path for h in engine.search(["legacy export csv"], "shop", mode="semantic", **how).collect()}
    assert "@deleted/old.ts" not in seen() and "@deleted/old.ts" in seen(include_history=True)
    near = engine.find_similar("shop", "src/queue.ts", 2).collect()
    assert near and all(r.path != "src/queue.ts" for r in near)
    with pytest.raises(NoSuchChunk):
        engine.find_similar("shop", "src/queue.ts", 999)
    assert [r.line for r in engine.expand_context("shop", "src/queue.ts", 2, 2, 1, 1).orderBy("line").collect()] == [1, 2, 3]
    assert "src/" in engine.repo_map("shop", depth=1) and "retryPayment" in engine.repo_map("shop", depth=1)
    row = engine.status().first()
    assert (row.files, row.history > 0) == (4, True)
    golden = spark.createDataFrame([("retry payment later", ["src/queue.ts::retryPayment"]), ("invoices customers", ["docs.md"])], "q string, expect array<string>")
    assert engine.evaluate(golden, mode="hybrid").first().recall_10 == 1.0
    assert engine.depth(golden).first().missing == 0
    assert engine.accept(golden).first().queries == 2
    assert engine.check_index(golden)[0].count() == 2
    chains = spark.createDataFrame([("retry payment later", 4, "src/queue.ts", None), ("nothing like it", 3, "none.ts", None)], "intent string, calls int, answer string, symbol string")
    assert engine.collapse(chains).first().asDict() == {"chains": 2, "collapsed": 1, "before": 7, "after": 5}
    engine.export_chunks(str(tmp_path / "x"))
    other = Engine(spark, f"file://{tmp_path}/other", HashingEmbedder(32))
    assert other.import_chunks(str(tmp_path / "x")) == engine.chunks().count() and other.import_chunks(str(tmp_path / "x")) == 0
    engine.drop_repo("shop")
    assert engine.locations().count() == 0
