"""Full-text search: postings, and a rank from term frequencies under OR semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import code_query, lexemes, words

# Fixed values of the rank: weight of a plain lexeme, the limit of sum 1 / j^2, and the frequency cap.
WEIGHT, LIMIT, MOST = 0.1, 1.64493406685, 256
#: Where an identifier may be taken apart. A text without such a place has each word twice: as it is, and apart.
_SEAM = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
#: Bytes of stored documents that a task takes at most, about: its scores are one a question and document.
SHARE = 8 << 20


def _sums() -> list[float]:
    """Sum of 1 / j^2 for j up to 1, 2, ... MOST."""
    out, s = [], 0.0
    for j in range(1, MOST + 1):
        s += 1.0 / (j * j)
        out.append(s)
    return out


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf), of the terms in ``wanted(term)`` if that is given.

    To be written once and searched often (``search_postings``).
    """
    t = F.col(text_col)
    seam = t.rlike(_SEAM)
    # two steps, so that the text is looked at before its words are rows
    each = docs.select(F.col(id_col), F.when(seam, 1).otherwise(2).alias("n"), F.when(seam, lexemes(t)).otherwise(words(t)).alias("terms"))
    some = each.select(id_col, "n", F.explode("terms").alias("term"))
    if wanted is not None:
        some = some.join(F.broadcast(wanted), "term", "left_semi")
    return some.groupBy(id_col, "term").agg(F.sum("n").alias("tf"))


def query_terms(questions: DataFrame, query_col: str, text_col: str) -> DataFrame:
    """(query_id, term, terms): distinct terms, with the number of them in the question."""
    rows = questions.select(F.col(query_col).alias("query_id"), code_query(F.col(text_col)).alias("all"))
    return rows.select("query_id", F.explode("all").alias("term"), F.size("all").alias("terms"))


def saturation(tf: Column) -> Column:
    """Sum of 1 / j^2 up to the (capped) term frequency, looked up."""
    return F.element_at(F.lit(_sums()), F.least(tf, F.lit(MOST)).cast("int"))


def search_postings(index: DataFrame, questions: DataFrame, n: int, id_col: str = "doc_id", query_col: str = "query_id", question_col: str = "text", live: DataFrame | None = None) -> DataFrame:
    """As ``search``, over (id, term, tf); of the ids in ``live`` only, if that is given."""
    asked = query_terms(questions, query_col, question_col)
    mine = index if live is None else index.join(live, id_col, "left_semi")
    # each posting is weighed before it meets the questions
    weighed = mine.select(id_col, "term", (F.lit(WEIGHT) * saturation(F.col("tf")) / F.lit(LIMIT)).alias("weight"))
    scores = weighed.join(F.broadcast(asked), "term").groupBy("query_id", id_col).agg(F.round(F.sum(F.col("weight") / F.col("terms")), 9).alias("lex"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lex"), id_col)))
    return ranked.where(F.col("rank") <= n).select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "lex")


def _tasks(docs: DataFrame) -> int:
    """Parts for documents: one for each share of the tables they are read from, and for each core."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # rows that are not read from files have no size, which is given as a huge one
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(x for x in sizes if x < 1 << 50) // SHARE))


def search(docs: DataFrame, questions: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", question_col: str = "text", live: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, lex): the n best documents with at least one term, ties to the smaller id.

    Documents are dealt by their id, in parts of bounded size: words are counted, weighed and ranked where their
    document is, so neither counts nor scores are shuffled, and a task's memory does not grow with the table. Terms
    that no question asks for are dropped before they are counted, and documents that are not ``live`` after.
    """
    docs = docs.select(id_col, text_col).repartition(_tasks(docs), id_col)
    wanted = query_terms(questions, query_col, question_col).select("term").distinct()
    return search_postings(postings(docs, id_col, text_col, wanted), questions, n, id_col, query_col, question_col, live)
