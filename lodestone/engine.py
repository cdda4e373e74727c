"""The engine: repositories in, answers out. Every method works set-wise over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.chunking.files import call_map, chunk_files
from lodestone.config import Config
from lodestone.functions.text import lang_for
from lodestone.operators import evaluate as E
from lodestone.operators import knn, maintain, present
from lodestone.plans import search as plans
from lodestone.sources import files, models

REPOS = "repo string, root string, head string, indexed_at timestamp"
FILES = "repo string, path string, sha string, lang string, indexed_at timestamp"
CHUNKS = "content_hash string, embed_text string, raw_text string, token_count int, model_id string, embedding array<float>"
LOCATIONS = "id long, repo string, path string, content_hash string, start_line int, end_line int, symbol string, kind string, parent_chain array<string>, lang string, exported boolean"


class NoSuchChunk(LookupError):
    """No chunk covers the line."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: models.Embedder, reranker: models.Reranker | None = None, config: Config | None = None):
        self.spark, self.store = spark, files.Snapshots(spark, root)
        self.embedder, self.reranker, self.config = embedder, reranker, config or Config(dims=embedder.dims)

    # tables

    def repos(self) -> DataFrame:
        return self.store.read("repos", REPOS)

    def files(self) -> DataFrame:
        return self.store.read("files", FILES)

    def chunks(self, all_models: bool = False) -> DataFrame:
        rows = self.store.read("chunks", CHUNKS)
        return rows if all_models else rows.where(F.col("model_id") == self.embedder.model_id)

    def locations(self, repo: str | None = None) -> DataFrame:
        rows = self.store.read("locations", LOCATIONS)
        return rows if repo is None else rows.where(F.col("repo") == repo)

    # indexing

    def add_repo(self, repo: str, root: str) -> None:
        row = self.spark.createDataFrame([(repo, root, None, None)], REPOS)
        self.store.commit({"repos": maintain.upsert(self.repos(), row, ["repo"])})

    def index_repo(self, repo: str, full: bool = False) -> dict[str, int]:
        """Bring a repository up to date: counts of changed, removed, new and reused chunks.

        Removals are found in full passes too, and files that are no longer admitted lose their chunks.
        """
        known = self.repos().where(F.col("repo") == repo).first()
        tree = files.read_tree(self.spark, known["root"]).where(files.admitted(F.col("path")) & ~F.col("path").startswith(".git/"))
        now = tree.where(files.refusal(F.col("text"), F.col("size"), F.col("path")).isNull()).withColumn("repo", F.lit(repo))
        return self.index_files(repo, now, files.head_commit(known["root"]), full, complete=True)

    def index_files(self, repo: str, now: DataFrame, head: str | None = None, full: bool = False, complete: bool = False) -> dict[str, int]:
        """Index given (repo, path, sha, text); with ``complete``, known files that are absent are removed."""
        mine = self.files().where(F.col("repo") == repo)
        states = maintain.changed(now.select("path", "sha"), mine)
        changed = now.join(states.where("status <> 'same'" if not full else "true").select("path"), "path", "left_semi")
        gone = maintain.removed(now, mine).select("path") if complete else mine.select("path").limit(0)
        calls = call_map(changed) if self.config.budget.callers else None
        made = chunk_files(changed, self.embedder.model_id, self.config.budget, calls).where("content_hash IS NOT NULL")
        place = made.select(F.xxhash64("repo", "path", "start_line", "end_line", "content_hash").alias("id"), "repo", "path", "content_hash", "start_line", "end_line", "symbol", "kind", "parent_chain", "lang", "exported")
        store = self.chunks(all_models=True)
        new = made.dropDuplicates(["content_hash"]).join(store.select("content_hash"), "content_hash", "left_anti").select("content_hash", "embed_text", "raw_text", "token_count", F.lit(self.embedder.model_id).alias("model_id"))
        embedded = models.embed(new, self.embedder).select(*[c.split()[0] for c in CHUNKS.split(", ")])
        touched = changed.select(F.lit(repo).alias("repo"), "path").unionByName(gone.select(F.lit(repo).alias("repo"), "path"))
        at = self.locations().join(touched, ["repo", "path"], "left_anti").unionByName(place)
        stamped = changed.select("repo", "path", "sha", lang_for(F.col("path")).alias("lang"), F.current_timestamp().alias("indexed_at"))
        listed = self.files().join(touched, ["repo", "path"], "left_anti").unionByName(stamped)
        before = store.count()
        counts = {"changed": changed.count(), "removed": gone.count(), "chunks": place.select("content_hash").distinct().count()}
        repo_row = self.repos().where(F.col("repo") == repo).withColumns({"head": F.lit(head).cast("string"), "indexed_at": F.current_timestamp()})
        self.store.commit({"chunks": store.unionByName(embedded), "locations": at, "files": listed, "repos": maintain.upsert(self.repos(), repo_row, ["repo"])})
        counts["new"] = self.chunks(all_models=True).count() - before
        return counts | {"reused": counts["chunks"] - counts["new"]}

    def index_history(self, repo: str, depth: int = 500) -> dict[str, int]:
        """Files deleted in the last commits, as they were before, under the history prefix."""
        root = self.repos().where(F.col("repo") == repo).first()["root"]
        gone = maintain.newest_deletion(files.deletions(self.spark, root, depth)).where(files.admitted(F.col("path")))
        rows = [(repo, f"{maintain.HISTORY}{r.path}", f"deleted:{r.ref}", text) for r in gone.toLocalIterator() if (text := files.show_file(root, r.ref, r.path)) is not None]
        return self.index_files(repo, self.spark.createDataFrame(rows, "repo string, path string, sha string, text string"))

    def drop_repo(self, repo: str) -> None:
        other = F.col("repo") != repo
        self.store.commit({"repos": self.repos().where(other), "files": self.files().where(other), "locations": self.locations().where(other)})

    def gc(self) -> int:
        """Drop chunks that occur nowhere."""
        rows = self.chunks(all_models=True)
        n = maintain.orphans(rows, self.locations()).count()
        self.store.commit({"chunks": maintain.live_chunks(rows, self.locations())})
        return n

    def export_chunks(self, path: str, model: str | None = None, repo: str | None = None) -> None:
        rows = maintain.export_rows(self.chunks(all_models=True), model, None if repo is None else self.locations(repo))
        files.write_exchange(rows, path)

    def import_chunks(self, path: str) -> int:
        store = self.chunks(all_models=True)
        new = maintain.import_rows(files.read_exchange(self.spark, path), store)
        n = new.count()
        self.store.commit({"chunks": store.unionByName(new.select(*store.columns))})
        return n

    # answers

    def _ask(self, questions: Sequence[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
        return models.embed(rows, self.embedder, "query", "text", "vector")

    def _parts(self, repo: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        at = self.locations(repo)
        wide = at.select("id", "content_hash").join(self.chunks(), "content_hash")
        return at, wide.select("id", "embedding"), wide.select("id", F.col("raw_text").alias("text"))

    def search(self, questions: Sequence[str], repo: str | None = None, k: int | None = None, mode: str | None = None, path_like: str | None = None, lang: str | None = None, include_history: bool = False, max_per_file: int | None = None, rerank: bool = True) -> DataFrame:
        """Ranked chunks for every question, with their text."""
        s = replace(self.config.search, include_deleted=include_history)
        s = replace(s, top_k=k or s.top_k, max_per_file=max_per_file or s.max_per_file, rerank=replace(s.rerank, enabled=s.rerank.enabled and rerank))
        at, vectors, texts = self._parts(repo)
        where: Column | None = None
        for cond in (F.col("path").like(path_like) if path_like else None, F.col("lang") == lang if lang else None):
            where = cond if where is None else where if cond is None else where & cond
        asked, scores = self._ask(questions), None
        run = lambda conf, sc=None: plans.search(asked, vectors, at, texts, conf, mode=mode, where=where, scores=sc)
        if self.reranker is not None and s.rerank.enabled:
            head = run(replace(s, top_k=s.rerank.candidates, max_per_file=s.rerank.candidates, rerank=replace(s.rerank, enabled=False)))
            wide = head.join(self.chunks().select("content_hash", "embed_text"), "content_hash").join(asked.select("query_id", F.col("text").alias("question")), "query_id")
            scores = models.rerank_scores(wide, self.reranker, s.rerank.candidates, strict=s.rerank.strict)
        return run(s, scores).join(self.chunks().select("content_hash", "raw_text"), "content_hash")

    def find_similar(self, repo: str, path: str, line: int, k: int = 8, exclude_same_file: bool = True, include_history: bool = False) -> DataFrame:
        at, vectors, texts = self._parts(repo)
        anchor = self.spark.createDataFrame([(0, path, line)], "query_id long, path string, line int")
        if at.where((F.col("path") == path) & F.lit(line).between(F.col("start_line"), F.col("end_line"))).isEmpty():
            raise NoSuchChunk(f"{path}:{line}")
        return plans.find_similar(anchor, vectors, at, k, exclude_same_file, include_history).join(texts.withColumnRenamed("text", "raw_text"), "id")

    def expand_context(self, repo: str, path: str, start: int, end: int, before: int = 20, after: int = 20) -> DataFrame:
        root = self.repos().where(F.col("repo") == repo).first()["root"]
        one = files.read_tree(self.spark, root).where(F.col("path") == path)
        return present.expand_context(one, start, end, before, after)

    def repo_map(self, repo: str, prefix: str = "", depth: int = 2, budget: int = 2000) -> str:
        """The directories that fit a budget, by name, with what they export."""
        at = self.locations(repo).where(~F.col("path").startswith(maintain.HISTORY) & F.col("path").like(f"{prefix}%"))
        rows = present.overview(at, depth, shown=F.col("exported") | (F.col("kind") == "file_card"))
        packed = present.pack_map(rows, budget)
        kept = packed.where("kept").orderBy("dir").collect()
        left = packed.where("NOT kept").agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("files")).first()
        tail = [f"... {left['n']} more directories ({left['files']} files): narrow the prefix or lower the depth"] if left["n"] else []
        return "\n".join([*(r["block"] for r in kept), *tail]) or "The index is empty or has no such repository."

    def status(self) -> DataFrame:
        return maintain.status(self.repos(), self.files(), self.locations())

    # measurement

    def _ranked(self, golden: DataFrame, k: int, **how) -> DataFrame:
        rows = golden.collect()  # a question set is written by hand
        asked = self.spark.createDataFrame([(i, r["expect"]) for i, r in enumerate(rows)], "query_id long, expect array<string>")
        got = self.search([r["q"] for r in rows], k=k, **how).withColumnRenamed("pos", "rank").join(asked, "query_id")
        hit = F.arrays_overlap("expect", E.match_keys(F.col("path"), F.col("symbol"), F.col("parent_chain")))
        return E.first_hits(asked, got, hit)

    def evaluate(self, golden: DataFrame, k: int = 10, mode: str | None = None, rerank: bool = True) -> DataFrame:
        return E.recall_mrr(self._ranked(golden, k, mode=mode, max_per_file=99, rerank=rerank))

    def depth(self, golden: DataFrame, depth: int = 300, include_history: bool = False) -> DataFrame:
        """Raw vector order, without priors or reranking."""
        rows = golden.collect()
        at, vectors, _ = self._parts(None)
        live = at if include_history else at.where(~F.col("path").startswith(maintain.HISTORY))
        near = knn.top_k(vectors.join(live.select("id"), "id", "left_semi"), self._ask([r["q"] for r in rows]), depth, id_col="id").join(live, "id")
        asked = self.spark.createDataFrame([(i, r["expect"]) for i, r in enumerate(rows)], "query_id long, expect array<string>")
        hit = F.arrays_overlap("expect", E.match_keys(F.col("path"), F.col("symbol"), F.col("parent_chain")))
        return E.depth_profile(E.first_hits(asked, near.join(asked, "query_id"), hit))

    def collapse(self, chains: DataFrame, k: int = 5) -> DataFrame:
        rows = chains.collect()
        golden = self.spark.createDataFrame([(r["intent"], [f"{r['answer']}::{r['symbol']}" if r["symbol"] else r["answer"]]) for r in rows], "q string, expect array<string>")
        calls = self.spark.createDataFrame([(i, r["calls"]) for i, r in enumerate(rows)], "query_id long, calls int")
        return E.collapse(calls.join(self._ranked(golden, k), "query_id"), F.coalesce(F.col("rank") <= k, F.lit(False)))

    def accept(self, golden: DataFrame) -> DataFrame:
        """Production settings at depth 50, with digests of the settings and the question set.

        ``unchanged`` is false if the index changed meanwhile, which voids the result.
        """
        rows = golden.collect()
        marks = {"settings": E.settings_digest(asdict(self.config)), "dataset": E.dataset_digest([(r["q"], list(r["expect"])) for r in rows])}
        state = lambda: tuple(E.state_digest(self.locations(), "repo", "path", "content_hash").first())
        before = state()
        found = self.spark.createDataFrame(*(lambda d: (d.collect(), d.schema))(E.acceptance(self._ranked(golden, 50))))
        return found.withColumns({k: F.lit(v) for k, v in marks.items()} | {"unchanged": F.lit(state() == before)})

    def check_index(self, golden: DataFrame, k: int = 50) -> tuple[DataFrame, list[str]]:
        """Approximate against exact lists for every question, and what is wrong."""
        rows = golden.collect()
        at, vectors, _ = self._parts(None)
        asked = self._ask([r["q"] for r in rows])
        exact = knn.top_k(vectors, asked, k, id_col="id")
        near = knn.approximate_top_k(vectors, asked, k, id_col="id", dims=self.embedder.dims)
        want = self.spark.createDataFrame([(i, r["expect"]) for i, r in enumerate(rows)], "query_id long, expect array<string>")
        hit = F.arrays_overlap("expect", E.match_keys(F.col("path"), F.col("symbol"), F.col("parent_chain")))
        placed = lambda hits: hits.join(at, "id").join(want, "query_id")
        lost = E.lost_answers(placed(exact), placed(near), hit)
        out = E.overlap(exact, near).join(lost, "query_id", "left")
        one = out.agg(F.avg("overlap").alias("mean"), F.min("overlap").alias("worst"), F.count_if("lost").alias("lost")).first()
        size = E.bloat(self.chunks(), at).first()["bloat"]
        # without questions there is nothing to find fault with
        return out, E.index_problems(E.Health(*(1.0 if one[c] is None else one[c] for c in ("mean", "worst")), one["lost"], size))
