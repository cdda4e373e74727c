"""Queries of index maintenance, chunking and streaming."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from lodestone.catalog.common import query, table
from lodestone.chunking import files as chunk
from lodestone.chunking import pack
from lodestone.functions.text import capped_list, frontmatter_field, is_markdown, lang_for, path_words, relative_links
from lodestone.operators import maintain
from lodestone.streaming import queue

_PRESENT = "SELECT source || '/' || doc_id AS path, sha256(text) AS sha FROM documents"
_KNOWN = "SELECT source || '/' || doc_id AS path, sha256(CASE WHEN toxic = 1 THEN text || 'x' ELSE text END) AS sha FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'page/' || page_id, sha256(url) FROM pages UNION ALL SELECT '@deleted/page/' || page_id, sha256(url) FROM pages"


def _present(spark, sf):
    return table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha"))


def _known(spark, sf):
    """The state of an earlier pass: labelled documents (toxic ones with another text), and pages."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    old = docs.select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"))
    pages = table(spark, sf, "pages")
    gone = pages.select(F.concat(F.lit("page/"), "page_id").alias("path"), F.sha2("url", 256).alias("sha"))
    return old.unionByName(gone).unionByName(gone.withColumn("path", F.concat(F.lit(maintain.HISTORY), "path")))


@query(f"WITH p AS ({_PRESENT}), k AS ({_KNOWN}) SELECT p.path, p.sha, CASE WHEN k.sha IS NULL THEN 'new' WHEN k.sha <> p.sha THEN 'changed' ELSE 'same' END AS status FROM p LEFT JOIN k USING (path)")
def changed_files(spark, sf):
    return maintain.changed(_present(spark, sf), _known(spark, sf))


@query(f"WITH p AS ({_PRESENT}), k AS ({_KNOWN}) SELECT path, sha FROM k WHERE NOT starts_with(path, '@deleted/') AND path NOT IN (SELECT path FROM p)")
def removed_files(spark, sf):
    return maintain.removed(_present(spark, sf), _known(spark, sf))


def _chunks(spark, sf):
    return table(spark, sf, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "lang")


def _stored(spark, sf):
    return _chunks(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("content_hash").distinct()


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def missing_hashes(spark, sf):
    return maintain.missing(_chunks(spark, sf), _stored(spark, sf))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)")
def orphan_gc(spark, sf):
    """Chunks that no good labelled document holds any more."""
    locations = _chunks(spark, sf).join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select("content_hash")
    return maintain.orphans(_chunks(spark, sf).select("content_hash").distinct(), locations)


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS places FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1) GROUP BY 1")
def live_chunks(spark, sf):
    locations = _chunks(spark, sf).join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select("content_hash")
    return maintain.live_chunks(_chunks(spark, sf), locations).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("places"))


@query("SELECT * FROM (SELECT o_custkey AS repo, 'o' || o_orderkey AS path, o_totalprice AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT c_custkey, 'c' || c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')")
def location_replace(spark, sf):
    """All rows of some keys are replaced: orders of BUILDING customers by one row each."""
    store = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_totalprice").alias("v"))
    new = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("repo"), F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("c_acctbal").alias("v"))
    return maintain.upsert(store, new, ["repo"])


@query(f"WITH p AS ({_PRESENT}), k AS ({_KNOWN}) SELECT path, sha FROM p UNION ALL SELECT path, sha FROM k WHERE path NOT IN (SELECT path FROM p)")
def upsert_files(spark, sf):
    return maintain.upsert(_known(spark, sf), _present(spark, sf), ["path"])


@query(f"WITH p AS ({_PRESENT}) SELECT content_hash, count(*) AS n FROM (SELECT DISTINCT sha256(text) AS content_hash FROM documents) GROUP BY 1")
def insert_new(spark, sf):
    """Two inserts of the same chunks leave one row each."""
    rows = _chunks(spark, sf).select("content_hash")
    once = maintain.insert_new(_stored(spark, sf), rows)
    return maintain.insert_new(once, rows).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH k AS ({_KNOWN}) SELECT path, sha FROM k WHERE path NOT IN ({_PRESENT.replace(', sha256(text) AS sha', '')})")
def delete_files(spark, sf):
    return maintain.delete_files(_known(spark, sf), _present(spark, sf))


@query("SELECT '@deleted/' || event_type || '/' || user_id AS path, 'deleted:' || (100000000 + arg_min(event_id, 1000000000 - event_id)) AS sha FROM events GROUP BY event_type, user_id")
def history_first_wins(spark, sf):
    """The newest deletion of each path: events, the largest id first."""
    log = table(spark, sf, "events").select(F.concat("event_type", F.lit("/"), "user_id").alias("path"), (F.lit(1_000_000_000) - F.col("event_id")).alias("ordinal"), (F.lit(100_000_000) + F.col("event_id")).cast("string").alias("ref"))
    return maintain.history_rows(maintain.newest_deletion(log))


_EXPORT = "SELECT sha256('v' || vec_id) AS h, 'e' || vec_id AS e, 'r' || label AS r, label AS t, CASE WHEN label < 5 THEN 'm1' ELSE 'm2' END AS m, len(embedding)::INT AS dims, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings"


def _store(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(F.sha2(F.concat(F.lit("v"), "vec_id"), 256).alias("content_hash"), F.concat(F.lit("e"), "vec_id").alias("embed_text"), F.concat(F.lit("r"), "label").alias("raw_text"), F.col("label").alias("token_count"), F.when(F.col("label") < 5, "m1").otherwise("m2").alias("model_id"), "embedding", "vec_id")


@query(_EXPORT + " WHERE label < 5")
def export_rows(spark, sf):
    numbers = F.split(F.regexp_replace("v", r"[\[\]]", ""), ",")
    return maintain.export_rows(_store(spark, sf), "m1").select("h", "e", "r", "t", "m", F.size(numbers).alias("dims"), F.round(numbers[0].cast("double"), 5).alias("first"))


@query(_EXPORT.replace(" AS h", " AS content_hash").replace(" AS e,", " AS embed_text,").replace(" AS r,", " AS raw_text,").replace(" AS t,", " AS token_count,").replace(" AS m,", " AS model_id,") + " WHERE label >= 5")
def import_dedupe(spark, sf):
    """Everything exported is imported, twice, into a store that has the first model's rows."""
    rows, store = maintain.export_rows(_store(spark, sf)), _store(spark, sf).where("model_id = 'm1'")
    new = maintain.import_rows(rows.unionByName(rows), store)
    return new.withColumn("dims", F.size("embedding")).withColumn("first", F.round(F.col("embedding")[0].cast("double"), 5)).drop("embedding")


@query("""WITH f AS (SELECT source AS repo, count(*) AS files, max(n_chars) AS indexed_at FROM documents GROUP BY 1),
l AS (SELECT source AS repo, count(*) FILTER (WHERE lang <> 'fr') AS live, count(*) FILTER (WHERE lang = 'fr') AS history, count(DISTINCT sha256(text)) AS chunks FROM documents GROUP BY 1),
r AS (SELECT DISTINCT source AS repo FROM documents UNION SELECT 'empty')
SELECT repo, coalesce(files, 0) AS files, indexed_at, coalesce(live, 0) AS live, coalesce(history, 0) AS history, coalesce(chunks, 0) AS chunks FROM r LEFT JOIN f USING (repo) LEFT JOIN l USING (repo)""")
def index_status(spark, sf):
    """Per source, with French documents as history; n_chars stands for the index time."""
    docs = table(spark, sf, "documents").withColumn("repo", F.col("source"))
    loc = docs.select("repo", F.concat(F.when(F.col("lang") == "fr", maintain.HISTORY).otherwise(""), "doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    repos = docs.select("repo").distinct().unionByName(spark.createDataFrame([("empty",)], "repo string"))
    return maintain.status(repos, docs.select("repo", F.col("n_chars").alias("indexed_at")), loc)


@query("SELECT count(*) AS locations, count(DISTINCT sha256(text)) AS chunks, max(n_chars) AS newest FROM documents")
def index_generation(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("locations"), F.count_distinct(F.sha2("text", 256)).alias("chunks"), F.max("n_chars").alias("newest"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: ceil(length(s) / 3.2::DOUBLE)::INT) AS costs FROM documents),
f AS (SELECT doc_id, costs, 1 AS i, costs[1] AS tokens, 0 AS part, 0 AS first FROM l
  UNION ALL SELECT doc_id, costs, i + 1, CASE WHEN tokens + costs[i + 1] > 200 THEN costs[i + 1] ELSE tokens + costs[i + 1] END, CASE WHEN tokens + costs[i + 1] > 200 THEN part + 1 ELSE part END, CASE WHEN tokens + costs[i + 1] > 200 THEN i ELSE first END FROM f WHERE i < len(costs))
SELECT doc_id, part::INT AS part, min(first)::INT AS first, (max(i) - 1)::INT AS last, max(tokens)::INT AS tokens FROM f GROUP BY doc_id, part""")
def line_pack(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(pack.pack_lines(F.col("text"), 200)).alias("part", "p"))
    return parts.select("doc_id", "part", "p.first", "p.last", "p.tokens")


_SPANS = "SELECT l_orderkey AS k, l_partkey % 100 * 10 AS a, l_partkey % 100 * 10 + l_quantity::BIGINT AS b FROM lineitem"


@query(f"WITH s AS ({_SPANS}), r AS (SELECT *, coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS to_ FROM s) SELECT k, to_ AS gap_start, a AS gap_end FROM r WHERE a > to_ UNION ALL SELECT k, max(b), 1100 FROM s GROUP BY k HAVING max(b) < 1100")
def gap_coverage(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_partkey % 100 * 10 AS a", "l_partkey % 100 * 10 + CAST(l_quantity AS BIGINT) AS b")
    return pack.gaps(s, "k", "a", "b", F.lit(1100).cast("long"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: ceil(length(s) / 3.2::DOUBLE)::INT) AS costs FROM documents),
f AS (SELECT doc_id, costs, 1 AS i, costs[1] AS tokens, 0 AS part FROM l
  UNION ALL SELECT doc_id, costs, i + 1, CASE WHEN tokens < 40 AND tokens + costs[i + 1] <= 500 THEN tokens + costs[i + 1] ELSE costs[i + 1] END, CASE WHEN tokens < 40 AND tokens + costs[i + 1] <= 500 THEN part ELSE part + 1 END FROM f WHERE i < len(costs))
SELECT doc_id, part::INT AS part, (min(i) - 1)::INT AS first, (max(i) - 1)::INT AS last, max(tokens)::INT AS tokens FROM f GROUP BY doc_id, part""")
def merge_small(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.struct(F.ceil(F.length(s) / F.lit(3.2)).cast("int").alias("tokens"), i.alias("first"), i.alias("last")))
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(pack.merge_small(lines, 40, 500)).alias("part", "p"))
    return parts.select("doc_id", "part", "p.first", "p.last", "p.tokens")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(string_split(url, '://')[-1], '[?#].*$', ''), '/$', '') AS path, list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS tags FROM pages),
l AS (SELECT page_id, '// repo: web' || chr(10) || '// file: ' || path AS always, chr(10) || '// path-words: ' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(path, '\.[a-zA-Z]+$', ''), '[/\\._\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+'), lambda w: length(w) > 1), ' ') AS words,
  chr(10) || '// imports: ' || array_to_string(tags[1:12], ', ') || CASE WHEN len(tags) > 12 THEN ' (+' || (len(tags) - 12) || ')' ELSE '' END AS imports FROM p)
SELECT page_id, always || CASE WHEN length(always || words || imports) <= 224 THEN words || imports WHEN length(always || words) <= 224 THEN words ELSE '' END AS header FROM l""")
def chunk_header(spark, sf):
    """The header of a small chunk: optional lines go, from the last, while it is over 70 tokens."""
    from lodestone.catalog.common import page_paths

    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)))
    rows = page_paths(spark, sf).join(table(spark, sf, "pages").select("page_id", tags.alias("tags")), "page_id")
    always = F.concat(F.lit("// repo: web\n// file: "), "path")
    words, imports = F.concat(F.lit("\n// path-words: "), path_words(F.col("path"))), F.concat(F.lit("\n// imports: "), capped_list(F.col("tags")))
    fits = lambda *parts: F.ceil(F.length(F.concat(*parts)) / F.lit(3.2)) <= 70
    kept = F.when(fits(always, words, imports), F.concat(always, words, imports)).when(fits(always, words), F.concat(always, words)).otherwise(always)
    return rows.select("page_id", kept.alias("header"))


_MD = "'---' || chr(10) || 'title: \"Page ' || page_id || '\"' || chr(10) || 'Description: about ' || url || chr(10) || '---' || chr(10) || '# Top' || chr(10) || '[a](./x.md#y) [b](' || url || ') [c](../' || page_id || '.md) [d](#z) [a](./x.md)' || chr(10) || '## Part' || chr(10) || 'text'"


@query("SELECT page_id, 'Page ' || page_id AS title, substr('about ' || url, 1, 200) AS description, './x.md,../' || page_id || '.md' AS links, 'markdown' AS lang, true AS prose FROM pages")
def frontmatter_links(spark, sf):
    """Front block fields and relative links of Markdown made from each page."""
    rows = table(spark, sf, "pages").select("page_id", F.expr(_MD).alias("text"))
    t, path = F.col("text"), F.lit("a/b.md")
    return rows.select("page_id", frontmatter_field(t, "title").alias("title"), frontmatter_field(t, "description").alias("description"), F.array_join(relative_links(t), ",").alias("links"), lang_for(path).alias("lang"), is_markdown(path).alias("prose"))


@query("SELECT page_id, kind, symbol, parents, start_line, end_line FROM (SELECT page_id, unnest([{'kind': 'file_card', 'symbol': 'Page ' || page_id, 'parents': '', 'start_line': 1, 'end_line': 1}, {'kind': 'section', 'symbol': 'Top, Part', 'parents': '', 'start_line': 5, 'end_line': 8}], recursive := true) FROM pages WHERE length('# Top' || chr(10) || '[a](./x.md#y) [b](' || url || ') [c](../' || page_id || '.md) [d](#z) [a](./x.md)') <= 124)")
def md_sections(spark, sf):
    """Sections of Markdown made from each page; a small one takes the next in."""
    rows = table(spark, sf, "pages").select(F.lit("web").alias("repo"), F.concat("page_id", F.lit(".md")).alias("path"), F.expr(_MD).alias("text"))
    out = chunk.chunk_files(rows)
    return out.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("page_id"), "kind", "symbol", F.array_join("parent_chain", ">").alias("parents"), "start_line", "end_line")


_TS = "'import { a' || page_id || ' } from \"./lib\"' || chr(10) || 'export function f' || page_id || '() {' || chr(10) || '  return helper(' || page_id || ')' || chr(10) || '}' || chr(10) || 'class K' || page_id || ' {' || chr(10) || '  run() { return execute(1) }' || chr(10) || '}'"


@query()
def code_chunks(spark, sf):
    """Chunks of TypeScript made from each page."""
    rows = table(spark, sf, "pages").select(F.lit("web").alias("repo"), F.concat("page_id", F.lit(".ts")).alias("path"), F.expr(_TS).alias("text"))
    return chunk.chunk_files(rows).drop("parent_chain")


@query("SELECT * FROM (SELECT 'helper' AS callee, array_to_string(list_sort(list('f' || page_id))[1:3], ',') AS callers FROM pages UNION ALL SELECT 'execute', array_to_string(['run'], ',')) t")
def call_map(spark, sf):
    rows = table(spark, sf, "pages").select(F.concat("page_id", F.lit(".ts")).alias("path"), F.expr(_TS).alias("text"))
    return chunk.call_map(rows).withColumn("callers", F.array_join("callers", ","))


_SESSIONS = "e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM e)"


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"WITH {_SESSIONS} SELECT user_id AS repo, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS events, count(DISTINCT event_type) AS paths, CASE WHEN count(DISTINCT event_type) >= 3 THEN 'overflow' ELSE 'debounce' END AS reason FROM s GROUP BY user_id, n")
def debounce_sessions(spark, sf):
    out = queue.sessions(_events(spark, sf), "6 hours", 3)
    return out.select("repo", F.unix_timestamp("start").alias("start"), "events", "paths", "reason")


@query(f"WITH {_SESSIONS} SELECT user_id AS repo, floor(epoch(min(ts)))::BIGINT AS start, greatest(1, ceil(count(DISTINCT event_type) / 2.0))::BIGINT AS flushes FROM s GROUP BY user_id, n")
def overflow_sessions(spark, sf):
    return queue.overflow_runs(_events(spark, sf), 2, "6 hours").select("repo", F.unix_timestamp("start").alias("start"), "flushes")


@query("WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id AS repo, event_type AS path, floor(epoch(max(ts)))::BIGINT AS last, count(*) AS events FROM s GROUP BY user_id, event_type, n")
def burst_dedup(spark, sf):
    out = queue.distinct_paths(_events(spark, sf), gap="6 hours")
    return out.select("repo", "path", F.unix_timestamp("last").alias("last"), "events")


@query(f"WITH {_SESSIONS} SELECT user_id AS repo, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS events, count(DISTINCT event_type) AS paths FROM s GROUP BY user_id, n")
def stream_debounce(spark, sf):
    """The same bursts from a file stream, in complete mode, by way of a table in the shared folder."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    rows = stream.select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    out = queue.sessions(rows.withWatermark("ts", "6 hours"), "6 hours", 3)
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestone-stream-")
    import uuid

    name = f"debounce_{uuid.uuid4().hex}"
    q = queue.whole(out, f"{folder}/{name}/rows", f"{folder}/{name}/state", name)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/{name}/rows").select("repo", F.unix_timestamp("start").alias("start"), "events", "paths")
