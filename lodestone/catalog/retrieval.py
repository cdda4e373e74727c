"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog.common import DIST, LEXICAL, NEAR, PAGES, VECTORS, page_paths, query, spread, table, text_questions, vector_questions
from lodestone.config import Rerank, Search
from lodestone.functions.text import estimate_tokens
from lodestone.operators import fusion, knn, lexical, maintain, present
from lodestone.plans import search as plans


def _near(spark, sf, k=50):
    return knn.top_k(table(spark, sf, "embeddings"), vector_questions(spark, sf), k)


def _lex(spark, sf, n=50):
    return lexical.search(spread(table(spark, sf, "documents").select("doc_id", "text")), text_questions(spark, sf), n)


_DOC_LOCATIONS = "doc_id AS id, source AS path, 'function' AS kind, CAST(doc_id AS STRING) AS symbol, lang, 1 AS start_line"


@query(
    f"""WITH {LEXICAL},
q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS c FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT query_id, vec_id AS id, {DIST.format("q.c", "e.c")} AS dist FROM q, (SELECT vec_id, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) e),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM vs QUALIFY rank <= 50),
both_ AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part, true AS is_vec FROM vec UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank), false FROM lex WHERE rank <= 50),
fused AS (SELECT query_id, id, round(sum(part), 9) AS score, bool_or(is_vec) AS in_vec, bool_or(NOT is_vec) AS in_lex FROM both_ GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM fused QUALIFY pos <= 60),
f AS (SELECT doc_id, min(CASE WHEN toxic = 1 THEN 0.5::DOUBLE WHEN quality = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) AS factor FROM labels GROUP BY doc_id),
scored AS (SELECT k.query_id, k.id, d.source AS path, round(k.score * coalesce(factor, 1.0::DOUBLE), 9) AS score, round(1 - vec.dist, 6) AS sim,
  CASE WHEN in_vec AND in_lex THEN 'both' WHEN in_vec THEN 'vector' ELSE 'lexical' END AS via, k.pos FROM kept k JOIN documents d ON d.doc_id = k.id LEFT JOIN f ON f.doc_id = k.id LEFT JOIN vec ON vec.query_id = k.query_id AND vec.id = k.id),
sorted AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS pos) FROM scored),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY pos) > 2 AS over_ FROM sorted)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY over_, pos)::INT AS pos, id, path, score, sim, via FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY over_, pos) <= 8"""
)
def hybrid_search(spark, sf):
    """Flagship: questions over documents by both branches, with label priors, two rows a source."""
    docs = table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    low = F.min(F.when(F.col("toxic") == 1, 0.5).when(F.col("quality") == 0, 0.7).otherwise(1.0)).alias("factor")
    factor = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(low)
    out = plans.search(text_questions(spark, sf), vectors, docs.selectExpr(*_DOC_LOCATIONS.split(", ")), spread(docs.select(F.col("doc_id").alias("id"), "text")), Search(penalties=()), mode="hybrid", factor=factor)
    return out.select("query_id", F.col("pos").cast("int").alias("pos"), "id", "path", "score", "sim", "via")


@query(f"WITH {LEXICAL} SELECT query_id, rank::INT AS rank, doc_id, lex FROM lex WHERE rank <= 50")
def lexical_search(spark, sf):
    return _lex(spark, sf)


@query(f"WITH {NEAR} SELECT query_id, rank::INT AS rank, vec_id, dist FROM near WHERE rank <= 50")
def knn_exact(spark, sf):
    return _near(spark, sf)


@query(f"WITH {VECTORS}, s AS (SELECT query_id, vec_id, {DIST.format('q.c', 'v.c')} AS dist FROM q, v WHERE v.label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, dist FROM r WHERE rank <= 50")
def knn_filtered(spark, sf):
    return knn.top_k(table(spark, sf, "embeddings").where("label = 3"), vector_questions(spark, sf), 50)


@query(
    f"""WITH {VECTORS}, loc AS (SELECT vec_id, 'own/' || vec_id AS path, 1 AS start_line FROM v UNION ALL SELECT doc_id % (SELECT max(vec_id) + 1 FROM v), source || '/' || doc_id, 1 FROM documents),
s AS (SELECT query_id, vec_id, {DIST.format("q.c", "v.c")} AS dist FROM q, v WHERE vec_id IN (SELECT vec_id FROM loc)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM s QUALIFY n <= 20),
r AS (SELECT query_id, vec_id, path, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, path, start_line, vec_id) AS rank FROM top JOIN loc USING (vec_id))
SELECT query_id, rank::INT AS rank, vec_id, path, dist FROM r WHERE rank <= 10"""
)
def knn_fanout(spark, sf):
    """One vector may lie in many places: each has one of its own, and documents are spread over all vectors."""
    v = table(spark, sf, "embeddings")
    most = v.agg(F.max("vec_id")).first()[0]
    own = v.selectExpr("vec_id", "concat('own/', vec_id) AS path", "1 AS start_line")
    loc = own.unionByName(table(spark, sf, "documents").selectExpr(f"doc_id % {most + 1} AS vec_id", "concat(source, '/', doc_id) AS path", "1 AS start_line"))
    out = knn.live_top_k(v, loc, vector_questions(spark, sf), 10)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "path", "dist")


@query(
    f"""WITH {VECTORS}, loc AS (SELECT doc_id AS id, source AS path, doc_id % 50 * 10 + 1 AS a, doc_id % 50 * 10 + 10 + doc_id % 7 AS b FROM documents JOIN v ON vec_id = doc_id),
anchors AS (SELECT DISTINCT source AS path, 25 AS line, source AS query_key FROM documents),
anc AS (SELECT anchors.path, id, row_number() OVER (PARTITION BY anchors.path ORDER BY b - a, a, id) AS n FROM anchors JOIN loc ON loc.path = anchors.path AND line BETWEEN a AND b QUALIFY n = 1),
s AS (SELECT anc.path AS anchor_path, anc.id AS anchor, loc.id, loc.path, loc.a, {DIST.format("x.c", "y.c")} AS dist FROM anc JOIN v x ON x.vec_id = anc.id JOIN loc ON loc.path <> anc.path AND loc.id <> anc.id JOIN v y ON y.vec_id = loc.id),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_path ORDER BY dist, path, a, id) AS rank FROM s)
SELECT anchor, rank::INT AS rank, id, path, round(1 - dist, 6) AS sim FROM r WHERE rank <= 8"""
)
def similar_chunks(spark, sf):
    """For line 25 of every source: neighbours of the smallest chunk there, other sources only."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    loc = table(spark, sf, "documents").selectExpr("doc_id AS id", "source AS path", "doc_id % 50 * 10 + 1 AS start_line", "doc_id % 50 * 10 + 10 + doc_id % 7 AS end_line").join(v.select("id"), "id", "left_semi")
    covering = loc.where("25 BETWEEN start_line AND end_line")
    w = Window.partitionBy("path").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id")
    anchors = covering.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("id").alias("query_id"), "path", F.lit(25).alias("line"))
    out = plans.find_similar(anchors, v, loc, 8)
    return out.select(F.col("query_id").alias("anchor"), F.col("rank").cast("int").alias("rank"), "id", "path", "sim")


_BRANCHES = """lists AS (
  SELECT query_id, 'exact' AS branch, vec_id AS id, rank FROM near WHERE rank <= 50
  UNION ALL SELECT query_id, 'half', vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) FROM near WHERE vec_id % 2 = 0 AND rank <= 100
  UNION ALL SELECT query_id, 'label', vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) FROM near WHERE label = q_label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 50)"""


def _lists(spark, sf):
    """Three ranked lists a question: nearest, nearest with even numbers, nearest of the same label."""
    q, v = vector_questions(spark, sf), table(spark, sf, "embeddings")
    near = knn.top_k(v, q, 100)
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    exact = near.where("rank <= 50").selectExpr("query_id", "'exact' AS branch", "vec_id AS id", "rank")
    half = near.where("vec_id % 2 = 0").withColumn("rank", F.row_number().over(w)).selectExpr("query_id", "'half' AS branch", "vec_id AS id", "rank")
    # the questions of a label are ranked against the vectors of that label, in one pass over them
    own = knn.top_k(v, q, 50, same=("label", "label"))
    return exact.unionByName(half).unionByName(own.selectExpr("query_id", "'label' AS branch", "vec_id AS id", "rank"))


def _fused_sql(weights: dict[str, float], depth: int) -> str:
    w = " ".join(f"WHEN '{b}' THEN {x}::DOUBLE" for b, x in weights.items())
    names = ", ".join(f"'{b}'" for b in weights)
    return f"WITH {NEAR}, {_BRANCHES} SELECT query_id, id, round(sum(CASE branch {w} END / (60 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT branch)), ',') AS branches FROM lists WHERE rank <= {depth} AND branch IN ({names}) GROUP BY ALL"


def _fused(spark, sf, weights, depth):
    return fusion.rrf(_lists(spark, sf), weights, depth=depth).withColumn("branches", F.array_join("branches", ","))


@query(_fused_sql({"exact": 1.0, "half": 0.5}, 100))
def rrf_two(spark, sf):
    return _fused(spark, sf, {"exact": 1.0, "half": 0.5}, 100)


@query(_fused_sql({"exact": 1.0, "half": 0.5, "label": 2.0}, 100))
def rrf_nbranch(spark, sf):
    return _fused(spark, sf, {"exact": 1.0, "half": 0.5, "label": 2.0}, 100)


@query(_fused_sql({"exact": 1.0, "half": 1.0, "label": 1.0}, 10))
def rrf_depth_limited(spark, sf):
    return _fused(spark, sf, {"exact": 1.0, "half": 1.0, "label": 1.0}, 10)


@query(f"WITH {NEAR}, {_BRANCHES}, m AS (SELECT * FROM range(1, 8) t(mask)) SELECT mask::INT AS mask, query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists, m WHERE rank <= 50 AND mask & (CASE branch WHEN 'exact' THEN 1 WHEN 'half' THEN 2 ELSE 4 END) <> 0 GROUP BY ALL")
def subset_sweep(spark, sf):
    return fusion.subsets(_lists(spark, sf), ["exact", "half", "label"])


_KIND = "CASE page_id % 5 WHEN 0 THEN 'file_card' WHEN 1 THEN 'binding' WHEN 2 THEN 'section' ELSE 'function' END"
_SYMBOL = "CASE WHEN page_id % 3 = 0 THEN NULL ELSE 's' END"
_FILE = "CASE page_id % 9 WHEN 0 THEN '@deleted/' ELSE '' END || CASE page_id % 4 WHEN 0 THEN 'src/test/' WHEN 1 THEN 'examples/' WHEN 2 THEN 'a/__tests__/' ELSE 'lib/' END || page_id || CASE page_id % 6 WHEN 0 THEN '.test.ts' WHEN 1 THEN '.md' ELSE '.ts' END"
_LANG = "CASE page_id % 6 WHEN 1 THEN 'markdown' ELSE 'typescript' END"


@query(
    f"""WITH p AS (SELECT page_id, {_FILE} AS path, {_KIND} AS kind, {_SYMBOL} AS symbol, {_LANG} AS lang FROM pages)
SELECT page_id, path, round(CASE WHEN kind = 'file_card' THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN kind IN ('binding', 'preamble') AND symbol IS NULL THEN 0.7::DOUBLE ELSE 1 END
 * CASE WHEN starts_with(path, '@deleted/') THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN lang = 'markdown' THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN regexp_matches(path, '(^|/)[^/]*\\.test\\.[^/]*$') THEN 0.4::DOUBLE ELSE 1 END
 * CASE WHEN contains('/' || path, '/test/') THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN contains('/' || path, '/__tests__/') THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN contains('/' || path, '/examples/') THEN 0.6::DOUBLE ELSE 1 END, 9) AS prior FROM p"""
)
def priors_applied(spark, sf):
    p = table(spark, sf, "pages").selectExpr("page_id", f"{_FILE} AS path", f"{_KIND} AS kind", f"{_SYMBOL} AS symbol", f"{_LANG} AS lang")
    return p.select("page_id", "path", F.round(fusion.prior(F.col("path"), F.col("kind"), F.col("symbol"), F.col("lang"), Search()), 9).alias("prior"))


def _ranked(spark, sf):
    """The nearest 40 of each question as search rows; the second opinion is a hash of the pair."""
    near = _near(spark, sf, 40)
    rows = near.select("query_id", F.col("vec_id").alias("id"), F.col("rank").alias("pos"), F.round(1 - F.col("dist"), 6).alias("score"), F.when(F.col("vec_id") % 3 == 0, 0.5).otherwise(1.0).alias("prior"))
    ce = rows.select("query_id", "id", (F.pmod(F.col("id") * 7919 + F.col("query_id") * 104729, F.lit(1000)) / 1000).alias("ce"))
    return rows, ce


_RANKED = NEAR + ", r AS (SELECT query_id, vec_id AS id, rank AS pos, round(1 - dist, 6) AS score, CASE WHEN vec_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS prior, (vec_id * 7919 + query_id * 104729) % 1000 / 1000 AS ce FROM near WHERE rank <= 40)"


def _rerank_sql(head: str) -> str:
    return f"""WITH {_RANKED}, h AS (SELECT *, pos <= 20 AS is_head, row_number() OVER (PARTITION BY query_id, pos <= 20 ORDER BY round(ce * prior, 9) DESC, pos) AS ce_rank FROM r),
n AS (SELECT *, CASE WHEN is_head THEN round({head}, 9) ELSE score END AS new FROM h)
SELECT query_id, id, new AS score, row_number() OVER (PARTITION BY query_id ORDER BY is_head DESC, CASE WHEN is_head THEN -new END, pos)::INT AS pos FROM n"""


@query(_rerank_sql("1.0::DOUBLE / (60 + pos) + 0.5::DOUBLE / (60 + ce_rank)"))
def rerank_fuse(spark, sf):
    rows, ce = _ranked(spark, sf)
    return fusion.rerank(rows, ce, Search()).select("query_id", "id", "score", "pos")


@query(_rerank_sql("ce * prior"))
def rerank_replace(spark, sf):
    rows, ce = _ranked(spark, sf)
    return fusion.rerank(rows, ce, Search(rerank=Rerank(fusion="replace"))).select("query_id", "id", "score", "pos")


@query(f"""WITH {LEXICAL}, r AS (SELECT query_id, doc_id, source, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS over_ FROM lex JOIN documents USING (doc_id) WHERE rank <= 50)
SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY over_, rank)::INT AS pos FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY over_, rank) <= 8""")
def diversified_topk(spark, sf):
    rows = _lex(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumnRenamed("rank", "pos")
    return fusion.diversify(rows, 8, 2, "source").select("query_id", "doc_id", "source", "pos")


@query(f"""WITH {LEXICAL}, r AS (SELECT query_id, doc_id, rank, ceil(length(text) / 3.2::DOUBLE)::BIGINT AS cost FROM lex JOIN documents USING (doc_id) WHERE rank <= 50),
s AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS spent, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r)
SELECT query_id, doc_id, rank::INT AS pos, cost, spent FROM s WHERE spent <= 4000 OR n = 1""")
def token_budget_cut(spark, sf):
    rows = _lex(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumnRenamed("rank", "pos")
    return present.budget_cut(rows, 4000, estimate_tokens(F.col("text"))).select("query_id", "doc_id", "pos", "cost", "spent")


@query(f"WITH {_RANKED}, o AS (SELECT query_id, score, lag(score) OVER (PARTITION BY query_id ORDER BY score * prior DESC, pos) AS before FROM r) SELECT query_id, bool_or(coalesce(score > before, false)) AS reordered FROM o GROUP BY query_id")
def order_notice(spark, sf):
    rows, _ = _ranked(spark, sf)
    moved = fusion.resort(rows.withColumn("sim", F.col("score")).withColumn("score", F.col("score") * F.col("prior")))
    return present.order_notice(moved)


@query(f"""WITH {_RANKED}, j AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, id) AS judge_rank FROM r WHERE ce >= 0.5),
o AS (SELECT r.query_id, r.id, r.pos, round(1.0::DOUBLE / (60 + r.pos) + coalesce(2.0::DOUBLE / (60 + judge_rank), 0), 9) AS score FROM r LEFT JOIN j USING (query_id, id))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos)::INT AS pos FROM o""")
def judge_fusion(spark, sf):
    rows, ce = _ranked(spark, sf)
    verdicts = ce.where("ce >= 0.5").withColumn("judge_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ce"), "id")))
    return fusion.judge(rows, verdicts).select("query_id", "id", "score", "pos")


@query(f"""WITH {_RANKED}, m AS (SELECT *, ce >= 0.7 AS pick, row_number() OVER (PARTITION BY query_id, ce >= 0.7 ORDER BY pos) AS n FROM r)
SELECT query_id, id, floor((pos - 1) / 30)::INT AS batch_no, row_number() OVER (PARTITION BY query_id ORDER BY (pick AND n <= 15) DESC, pos)::INT AS pos FROM m""")
def promote_only_cascade(spark, sf):
    rows, ce = _ranked(spark, sf)
    return fusion.cascade(rows.join(ce, ["query_id", "id"]), F.col("ce") >= 0.7).select("query_id", "id", "batch_no", "pos")


@query(f"WITH {PAGES} SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS dir, count(DISTINCT path) AS files, array_to_string(list_sort(list(DISTINCT symbol))[1:40], ',') AS symbols FROM pp GROUP BY 1")
def repo_overview(spark, sf):
    return present.overview(page_paths(spark, sf)).withColumn("symbols", F.array_join("symbols", ","))


_MAP = f"""WITH RECURSIVE {PAGES}, d AS (SELECT string_split(path, '/')[1] AS dir, count(DISTINCT path) AS files, list_sort(list(DISTINCT symbol))[1:40] AS symbols FROM pp GROUP BY 1),
t AS (SELECT count(*) AS dirs, sum(files) AS total, least(25, greatest(3, round(600.0::DOUBLE / count(*) / 4)::INT)) AS cap FROM d),
b AS (SELECT dir, files, CASE WHEN regexp_matches(dir, '\\.[a-zA-Z]+$') THEN dir ELSE dir || '/' END || '  (' || files || ' files)' || chr(10) || '  exports: ' || array_to_string(symbols[1:cap], ', ') || CASE WHEN len(symbols) > cap THEN ' (+' || (len(symbols) - cap) || ')' ELSE '' END AS block,
  row_number() OVER (ORDER BY files DESC, dir) AS n FROM d, t),
c AS (SELECT *, ceil(length(block) / 3.2::DOUBLE)::BIGINT AS cost FROM b),
f AS (SELECT 0::BIGINT AS n, ceil(length(dirs || ' directories, ' || total || ' files') / 3.2::DOUBLE)::BIGINT AS spent, 0::BIGINT AS kept, '' AS dir, false AS is_kept FROM t
  UNION ALL SELECT c.n, CASE WHEN f.kept > 0 AND f.spent + cost > 600 THEN f.spent ELSE f.spent + cost END, CASE WHEN f.kept > 0 AND f.spent + cost > 600 THEN f.kept ELSE f.kept + 1 END, c.dir, NOT (f.kept > 0 AND f.spent + cost > 600) FROM f JOIN c ON c.n = f.n + 1)
SELECT c.dir, c.files, c.block, f.is_kept AS kept FROM c JOIN f USING (n)"""


@query(_MAP)
def repo_map_packed(spark, sf):
    return present.pack_map(present.overview(page_paths(spark, sf), depth=1), 600)


@query("""SELECT doc_id, line::INT AS line, text, line BETWEEN 5 AND 6 AS inside FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE line BETWEEN 2 AND 9""")
def expand_context(spark, sf):
    return present.expand_context(table(spark, sf, "documents"), 5, 6, 3, 3, id_col="doc_id")


@query()
def ann_overlap(spark, sf):
    """Approximate against exact at 50: no SQL, the hyperplanes are drawn in numpy."""
    from lodestone.operators.evaluate import overlap

    q, v = vector_questions(spark, sf), table(spark, sf, "embeddings")
    exact = knn.top_k(v, q, 50).withColumnRenamed("vec_id", "id")
    return overlap(exact, knn.approximate_top_k(v, q, 50).withColumnRenamed("vec_id", "id"))


@query(f"""WITH {VECTORS}, f AS (SELECT *, CASE WHEN label = 4 THEN '@deleted/' ELSE '' END || 'f' || label AS path FROM v)
SELECT label, count(*) AS chunks, count(*) FILTER (WHERE starts_with(path, '@deleted/')) AS history FROM f WHERE path LIKE '%f%' AND NOT path LIKE '%9' GROUP BY label""")
def history_scope(spark, sf):
    """Path patterns (SQL LIKE) and the history prefix."""
    rows = table(spark, sf, "embeddings").withColumn("path", F.concat(F.when(F.col("label") == 4, maintain.HISTORY).otherwise(""), F.lit("f"), F.col("label").cast("string")))
    kept = rows.where(F.col("path").like("%f%") & ~F.col("path").like("%9"))
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("path").startswith(maintain.HISTORY)).alias("history"))


@query(f"""WITH {_RANKED}, d AS (SELECT unnest([10, 20, 40]) AS depth), w AS (SELECT unnest([0.5::DOUBLE, 1, 2]) AS weight),
h AS (SELECT depth, weight, r.*, row_number() OVER (PARTITION BY depth, weight, query_id ORDER BY round(ce * prior, 9) DESC, pos) AS ce_rank FROM r, d, w WHERE pos <= depth),
n AS (SELECT *, round(1.0::DOUBLE / (60 + pos) + weight / (60 + ce_rank), 9) AS new FROM h)
SELECT depth, weight, query_id, id, row_number() OVER (PARTITION BY depth, weight, query_id ORDER BY new DESC, pos)::INT AS pos FROM n QUALIFY row_number() OVER (PARTITION BY depth, weight, query_id ORDER BY new DESC, pos) <= 5""")
def rerank_sweep(spark, sf):
    rows, ce = _ranked(spark, sf)
    return fusion.rerank_sweep(rows, ce, [10, 20, 40], [0.5, 1.0, 2.0])


@query(f"""WITH {_RANKED}, b AS (SELECT *, greatest(score, ce) AS best FROM r), k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank_a, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, id) AS rank_b, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, id) AS rank_max FROM b)
SELECT query_id, id, rank_a::INT AS rank_a, rank_b::INT AS rank_b, rank_max::INT AS rank_max, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + rank_a) + 1.0::DOUBLE / (60 + rank_b), 9) DESC, id)::INT AS rank_rrf FROM k""")
def two_views(spark, sf):
    rows, ce = _ranked(spark, sf)
    return fusion.two_views(rows.join(ce, ["query_id", "id"]), "score", "ce")


@query(f"""WITH {NEAR}, {_BRANCHES}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY ALL), n AS (SELECT id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM f)
SELECT DISTINCT id FROM (SELECT id FROM n WHERE n <= 40 UNION ALL SELECT item_id FROM benchmark)""")
def description_pool(spark, sf):
    return fusion.pool(_lists(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("id")))
