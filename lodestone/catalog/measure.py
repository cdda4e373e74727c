"""Queries of evaluation, health and acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.common import DIST, LEXICAL, NEAR, VECTORS, query, table, text_questions, vector_questions
from lodestone.catalog.retrieval import _BRANCHES, _lex, _lists, _near
from lodestone.operators import evaluate as E
from lodestone.operators import knn

# A question (vector) is answered by a vector of its label; its own vector does not count.
_HITS = NEAR + ", hits AS (SELECT query_id, min(rank) AS rank FROM near WHERE label = q_label AND vec_id <> query_id AND rank <= 300 GROUP BY query_id), ranks AS (SELECT q.query_id, rank FROM q LEFT JOIN hits USING (query_id))"


def _ranks(spark, sf, depth=300):
    q = vector_questions(spark, sf)
    near = knn.top_k(table(spark, sf, "embeddings"), q, depth)
    labelled = near.join(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("own")), "vec_id").join(q.select("query_id", "label"), "query_id")
    return E.first_hits(q, labelled, (F.col("own") == F.col("label")) & (F.col("vec_id") != F.col("query_id")))


def _recall(d: int) -> str:
    return f"round(avg(CASE WHEN rank <= {d} THEN 1.0::DOUBLE ELSE 0 END), 6)"


@query(f"WITH {_HITS} SELECT count(*) AS queries, {_recall(1)} AS recall_1, {_recall(5)} AS recall_5, {_recall(10)} AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM ranks")
def recall_mrr(spark, sf):
    return E.recall_mrr(_ranks(spark, sf))


@query(f"WITH {_HITS} SELECT count(*) AS queries, {', '.join(f'{_recall(d)} AS at_{d}' for d in (1, 5, 10, 50, 300))}, count(*) FILTER (WHERE rank IS NULL) AS missing, list_sort(list(rank) FILTER (WHERE rank IS NOT NULL))[floor(count(rank) * 0.5)::INT + 1]::INT AS median_rank FROM ranks")
def depth_profile(spark, sf):
    return E.depth_profile(_ranks(spark, sf))


@query(f"WITH {_HITS} SELECT CASE {' '.join(f'WHEN rank <= {e} THEN {chr(39)}to_{e}{chr(39)}' for e in (1, 5, 10, 20, 50, 100, 300))} ELSE 'over_300' END AS bucket, count(*) AS n FROM ranks GROUP BY 1")
def rank_histogram(spark, sf):
    return E.rank_histogram(_ranks(spark, sf))


@query(f"""WITH {_HITS}, a AS (SELECT count(*) AS queries, count(*) FILTER (WHERE rank <= 5)::DOUBLE AS h, count(*)::DOUBLE AS n, {_recall(1)} AS recall_1, {_recall(5)} AS recall_5, {_recall(10)} AS recall_10, {_recall(50)} AS recall_50,
  round(1 - avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_50, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_10, round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_50 FROM ranks),
w AS (SELECT *, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((h / n * (1 - h / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6)::DOUBLE AS wilson_5 FROM a)
SELECT queries, recall_1, recall_5, recall_10, recall_50, wilson_5, missing_50, mrr_10, mrr_50, recall_5 >= 0.40 AND wilson_5 >= 0.33 AND recall_10 >= 0.48 AND missing_50 <= 0.45 AS accepted FROM w""")
def acceptance_row(spark, sf):
    return E.acceptance(_ranks(spark, sf))


@query("SELECT p_brand, h AS hits, n, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((h / n * (1 - h / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6)::DOUBLE AS bound FROM (SELECT p_brand, count(*) FILTER (WHERE p_size > 25)::DOUBLE AS h, count(*)::DOUBLE AS n FROM part GROUP BY 1)")
def wilson_bound(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("n"))
    return rows.withColumn("bound", F.round(E.wilson_lower(F.col("hits"), F.col("n")), 6))


@query("SELECT l[floor(n * 0.5)::BIGINT + 1] AS p50, l[floor(n * 0.95)::BIGINT + 1] AS p95 FROM (SELECT list_sort(list(value)) AS l, count(value) AS n FROM events)")
def latency_percentiles(spark, sf):
    return E.nearest_ranks(table(spark, sf, "events"), "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH c AS (SELECT conv_id, count(*) AS calls FROM conversations GROUP BY 1), f AS (SELECT conv_id, calls, conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS found FROM c)
SELECT count(*) AS chains, count(*) FILTER (WHERE found) AS collapsed, sum(calls)::BIGINT AS before, sum(CASE WHEN found THEN 1 ELSE calls + 1 END)::BIGINT AS after FROM f""")
def collapse_savings(spark, sf):
    """A conversation is a chain with a call a turn; it is answered if its number is a good document."""
    chains = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("calls"))
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id")).distinct().withColumn("found", F.lit(True))
    return E.collapse(chains.join(good, "conv_id", "left"), F.coalesce("found", F.lit(False)))


@query(f"WITH {LEXICAL}, p AS (SELECT query_id, source, count(*) AS n FROM lex JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY ALL) SELECT query_id, count(*) AS files, max(n) AS most FROM p GROUP BY query_id")
def file_clustering(spark, sf):
    rows = _lex(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return E.clustering(rows, 20, "source")


@query(f"WITH {NEAR}, {_BRANCHES} SELECT query_id, count(DISTINCT id) AS size, count(DISTINCT branch) AS branches FROM lists WHERE rank <= 20 GROUP BY query_id")
def union_availability(spark, sf):
    return E.union_availability(_lists(spark, sf), 20)


@query(f"WITH {NEAR}, {_BRANCHES}, h AS (SELECT DISTINCT l.query_id, branch FROM lists l JOIN v ON v.vec_id = l.id JOIN q ON q.query_id = l.query_id WHERE rank <= 5 AND v.label = q.label AND l.id <> l.query_id), n AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1) SELECT branch, count(*) AS hits, count(*) FILTER (WHERE n = 1) AS alone FROM h JOIN n USING (query_id) GROUP BY branch")
def unique_contribution(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    q = vector_questions(spark, sf).select("query_id", F.col("label").alias("own"))
    hits = _lists(spark, sf).where("rank <= 5").join(labels, "id").join(q, "query_id").where("label = own AND id <> query_id").select("query_id", "branch")
    return E.unique_contribution(hits)


@query(f"WITH {NEAR}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM near WHERE vec_id % 10 <> 3), e AS (SELECT query_id, vec_id FROM near WHERE rank <= 50), o AS (SELECT query_id, vec_id FROM h WHERE n <= 50) SELECT query_id, count(*) AS exact, count(o.vec_id) AS shared, round(count(o.vec_id)::DOUBLE / count(*), 6) AS overlap FROM e LEFT JOIN o USING (query_id, vec_id) GROUP BY query_id")
def health_overlap(spark, sf):
    """Exact lists against those of a damaged index that lost a tenth of its vectors."""
    exact = _near(spark, sf, 50).withColumnRenamed("vec_id", "id")
    damaged = knn.top_k(table(spark, sf, "embeddings").where("vec_id % 10 <> 3"), vector_questions(spark, sf), 50)
    return E.overlap(exact, damaged.withColumnRenamed("vec_id", "id"))


@query(f"WITH {LEXICAL}, h AS (SELECT query_id, min(rank) AS rank FROM lex JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 50 AND contains(d.text, b.text) GROUP BY 1) SELECT item_id AS query_id, rank::INT AS rank FROM benchmark LEFT JOIN h ON query_id = item_id")
def passage_ranks(spark, sf):
    """The rank of the first document that contains the question's passage."""
    rows = _lex(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(text_questions(spark, sf).select("query_id", F.col("text").alias("passage")), "query_id")
    return E.first_hits(text_questions(spark, sf), rows, F.contains(F.col("text"), F.col("passage")))


@query(f"WITH {VECTORS} SELECT label, round(min({DIST.format('v.c', 'w.c')}), 6) AS nearest FROM v JOIN (SELECT c AS c, label AS l FROM v WHERE vec_id = 0) w ON true GROUP BY label")
def label_distance(spark, sf):
    """Distance of every label's nearest vector to vector 0, as a plain cross join with one row."""
    from lodestone.functions.vector import cosine_distance

    v = table(spark, sf, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("w"))
    d = F.round(cosine_distance(F.col("embedding"), F.col("w")), 6)
    return v.crossJoin(F.broadcast(one)).groupBy("label").agg(F.round(F.min(d), 6).alias("nearest"))


@query(f"""WITH {NEAR}, hit AS (SELECT query_id, bool_or(label = q_label AND vec_id <> query_id) AS found, bool_or(vec_id % 3 = 0 AND label = q_label AND vec_id <> query_id) AS reached FROM near WHERE rank <= 20 GROUP BY query_id)
SELECT query_id, found AND NOT reached AS lost FROM hit""")
def lost_answers(spark, sf):
    """Against a list that misses two rows of three: which questions lose their answer (a vector of their label)."""
    q, v = vector_questions(spark, sf), table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("own"))
    exact = _near(spark, sf, 20).join(v, "vec_id").join(q.select("query_id", "label"), "query_id")
    return E.lost_answers(exact, exact.where("vec_id % 3 = 0"), (F.col("own") == F.col("label")) & (F.col("vec_id") != F.col("query_id")))


@query("SELECT count(*) AS stored, count(*) FILTER (WHERE vec_id IN (SELECT doc_id FROM labels)) AS live, round(count(*) / count(*) FILTER (WHERE vec_id IN (SELECT doc_id FROM labels)), 6) AS bloat FROM embeddings")
def index_bloat(spark, sf):
    """Vectors stored for each whose document has a label."""
    return E.bloat(table(spark, sf, "embeddings"), table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id")


@query("SELECT count(*) AS inputs, count(*) FILTER (WHERE length(text) / 3.2::DOUBLE > 2048) AS truncated, round(count(*) FILTER (WHERE length(text) / 3.2::DOUBLE > 2048) / count(*), 6) AS rate, round(count(*) FILTER (WHERE length(text) / 3.2::DOUBLE > 2048) / count(*), 6) > 0.05 AS alarm FROM documents")
def embed_stats(spark, sf):
    return E.embed_stats(table(spark, sf, "documents"))


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(source || chr(31) || doc_id), 1, 8))::BIGINT)::BIGINT AS digest FROM documents")
def state_digest(spark, sf):
    return E.state_digest(table(spark, sf, "documents"), "source", "doc_id")
