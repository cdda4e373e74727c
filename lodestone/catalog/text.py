"""Queries of the text and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.common import CODE_QUERY, CODE_TOKENS, PAGES, page_paths, query, table
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.sources.files import admitted, refusal


@query(f"SELECT page_id, {CODE_TOKENS.format('url')} AS tokens FROM pages")
def code_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.code_tokens(F.col("url")).alias("tokens"))


@query(f"SELECT page_id, array_to_string(list_sort({CODE_QUERY.format('url')}), ' ') AS terms FROM pages")
def code_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(T.code_query(F.col("url"))), " ").alias("terms"))


@query(f"WITH {PAGES} " + r"""SELECT page_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(path, '\.[a-zA-Z]+$', ''), '[/\\._\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+'), lambda w: length(w) > 1), ' ') AS words FROM pp""")
def path_words(spark, sf):
    return page_paths(spark, sf).select("page_id", T.path_words(F.col("path")).alias("words"))


@query("SELECT doc_id, ceil(length(text) / 3.2::DOUBLE)::BIGINT AS tokens, length(text) / 3.2::DOUBLE > 2048 AS truncated, CASE WHEN length(text) <= 128 THEN 128 WHEN length(text) <= 256 THEN 256 WHEN length(text) <= 512 THEN 512 WHEN length(text) <= 1024 THEN 1024 ELSE 2048 END AS bucket FROM documents")
def token_estimates(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(t).alias("tokens"), T.truncated(t).alias("truncated"), T.length_bucket(F.length(t)).alias("bucket"))


@query("SELECT doc_id, substr(text, 1, 160) AS head FROM documents")
def truncate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), 50).alias("head"))


@query("SELECT doc_id, sha256(concat('m1', chr(0), text)) AS content_hash, sha256(text) AS body_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.lit("m1"), F.col("text")).alias("content_hash"), F.sha2("text", 256).alias("body_hash"))


@query("SELECT sha256(text) AS body_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_copies(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("body_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


_PATH = "CASE page_id % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'a/secrets/' WHEN 3 THEN 'docs/' WHEN 4 THEN '' WHEN 5 THEN 'pkg/dist/' ELSE 'lib/' END || page_id || CASE page_id % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.min.js' WHEN 2 THEN '.md' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.TSX' WHEN 5 THEN '.py' ELSE '.mjs' END"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, path, regexp_matches(path, '\\.([tT][sS][xX]?|mjs|md|js)$') AND NOT regexp_matches(path, '(^|/)(node_modules|secrets|dist)/') AND NOT regexp_matches(path, '\\.(min\\.js|d\\.ts)$') AS admitted FROM p""")
def admission_filter(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return rows.withColumn("admitted", admitted(F.col("path")))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 1048576 THEN 'large' WHEN instr(text, chr(0)) > 0 THEN 'binary' WHEN length(text) / len(string_split(text, chr(10))) > 200 THEN 'minified' END AS refusal FROM documents")
def content_admission(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", refusal(F.col("text"), F.octet_length("text"), F.lit("a.ts")).alias("refusal"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace('title: none | text: ' || text, '\s+', ' ', 'g'))) AS input FROM documents")
def model_prefix_collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.model_input(F.col("text"), "gemma", "document"), 256).alias("input"))


@query("SELECT vec_id, list_transform(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), lambda x: round(x, 6) + 0) AS unit FROM embeddings")
def vector_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.normalise(F.col("embedding")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("SELECT vec_id, list_transform(list_transform((embedding::DOUBLE[])[1:16], lambda x: x / sqrt(list_inner_product((embedding::DOUBLE[])[1:16], (embedding::DOUBLE[])[1:16]))), lambda x: round(x, 6) + 0) AS unit FROM embeddings")
def vector_truncate(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.truncate(F.col("embedding"), 16), lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query(r"""SELECT doc_id, CASE WHEN len(l) > 15 THEN array_to_string(l[1:10], chr(10)) || chr(10) || '... ' || (len(l) - 14) || ' lines' || chr(10) || array_to_string(l[-4:], chr(10)) ELSE text END AS shown FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def trimmed_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.trim_lines(F.col("text")).alias("shown"))


@query(r"""SELECT page_id, array_to_string(list_slice(l, 1, 12), ', ') || CASE WHEN len(l) > 12 THEN ' (+' || (len(l) - 12) || ')' ELSE '' END AS links, len(l)::INT AS n FROM (
  SELECT page_id, list_filter(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)), lambda x: x <> '') AS l0, list_sort(l0) AS l FROM pages)""")
def capped_lists(spark, sf):
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)))
    return table(spark, sf, "pages").select("page_id", T.capped_list(tags).alias("links"), F.size(tags).alias("n"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS p, least(9, greatest(2, floor(value)::BIGINT)) AS level, strftime(ts, '%Y-%m-%d %H:%M') AS stamp FROM events")
def scalar_functions(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(T.sigmoid(F.col("value") / 100), 9).alias("p"), T.clamp(F.floor("value"), 2, 9).cast("long").alias("level"), T.utc_stamp(F.col("ts")).alias("stamp"))
