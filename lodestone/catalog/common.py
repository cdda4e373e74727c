"""Roles that the tables play in the catalogue, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of few files over all cores, for work that costs more than moving its rows; else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every 20th vector is a question."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def text_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items, with the vector of the same number."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files: host and path of the URL, with a language of the first segment."""
    rest = F.substring_index("url", "://", -1)
    path = F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), "/$", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path"), F.split(path, "/")[1].alias("symbol"))


CODE_TOKENS = r"""({0} || ' ' || regexp_replace(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-/.]+', ' ', 'g'))"""
CODE_QUERY = "list_distinct(list_filter(regexp_split_to_array(lower(" + CODE_TOKENS + "), '[^a-z0-9_]+'), lambda w: length(w) > 1 AND NOT contains(w, '_')))"
LEXEMES = "list_filter(regexp_split_to_array(lower(" + CODE_TOKENS + r"), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
DIST = "round(1 - list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1}))), 6)"
VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS c, label FROM embeddings), q AS (SELECT vec_id AS query_id, c, label FROM v WHERE vec_id % 20 = 0)"
NEAR = VECTORS + ", s AS (SELECT query_id, vec_id, " + DIST.format("q.c", "v.c") + " AS dist, q.label AS q_label, v.label FROM q, v), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s)"
PAGES = r"p AS (SELECT page_id, regexp_replace(regexp_replace(string_split(url, '://')[-1], '[?#].*$', ''), '/$', '') AS path FROM pages), pp AS (SELECT *, string_split(path, '/')[2] AS symbol FROM p)"
LEXICAL = (
    "asked AS (SELECT item_id AS query_id, unnest(t) AS term, len(t) AS terms FROM (SELECT item_id, " + CODE_QUERY.format("text") + " AS t FROM benchmark)), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + LEXEMES.format("text") + ") AS term FROM documents) GROUP BY ALL), "
    "ls AS (SELECT query_id, doc_id, round(sum(0.1 * list_sum(list_transform(range(1, least(tf, 256) + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 / terms), 9) AS lex FROM tf JOIN asked USING (term) GROUP BY ALL), "
    "lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, doc_id) AS rank FROM ls)"
)
