"""Incremental maintenance as set operations: what changed, what is missing, what is garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = "@deleted/"


def changed(present: DataFrame, known: DataFrame) -> DataFrame:
    """Manifest rows (path, sha) that are new or differ from the known state: path, sha, status."""
    k = known.select("path", F.col("sha").alias("known_sha"))
    joined = present.join(k, "path", "left")
    status = F.when(F.col("known_sha").isNull(), "new").when(~F.col("sha").eqNullSafe(F.col("known_sha")), "changed").otherwise("same")
    return joined.select("path", "sha", status.alias("status"))


def removed(present: DataFrame, known: DataFrame) -> DataFrame:
    """Known paths that are gone; history is not."""
    return known.where(~F.col("path").startswith(HISTORY)).join(present.select("path"), "path", "left_anti")


def missing(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct hashes that the store lacks: only these are embedded."""
    return chunks.select("content_hash").distinct().join(store.select("content_hash"), "content_hash", "left_anti")


def insert_new(store: DataFrame, rows: DataFrame, key: str = "content_hash") -> DataFrame:
    """The store with rows of unknown keys; the first of equal new keys counts once."""
    new = rows.join(store.select(key), key, "left_anti").dropDuplicates([key])
    return store.unionByName(new)


def upsert(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The store with ``rows`` in place of those with their keys (also: all locations of a file)."""
    return store.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def delete_files(locations: DataFrame, paths: DataFrame) -> DataFrame:
    return locations.join(paths.select("path").distinct(), "path", "left_anti")


def live_chunks(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """Chunks that occur somewhere; the rest is garbage."""
    return chunks.join(locations.select("content_hash").distinct(), "content_hash", "left_semi")


def orphans(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    return chunks.join(locations.select("content_hash").distinct(), "content_hash", "left_anti")


def newest_deletion(log: DataFrame) -> DataFrame:
    """(path, ordinal, ref) -> (path, ref): the deletion with the least ordinal; ties to the smaller ref."""
    return log.groupBy("path").agg(F.min(F.struct("ordinal", "ref"))["ref"].alias("ref"))


def history_rows(deleted: DataFrame) -> DataFrame:
    """Deleted files under their own prefix, with a sha that names the commit."""
    return deleted.select(F.concat(F.lit(HISTORY), "path").alias("path"), F.concat(F.lit("deleted:"), "ref").alias("sha"))


def export_rows(chunks: DataFrame, model: str | None = None, locations: DataFrame | None = None) -> DataFrame:
    """Chunks in the exchange format h, e, r, t, m, v; of one model or of the chunks in ``locations``."""
    rows = chunks if model is None else chunks.where(F.col("model_id") == model)
    if locations is not None:
        rows = live_chunks(rows, locations)
    return rows.select(F.lower(F.hex(F.unhex("content_hash"))).alias("h"), F.col("embed_text").alias("e"), F.col("raw_text").alias("r"), F.col("token_count").alias("t"), F.col("model_id").alias("m"), F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]")).alias("v"))


def import_rows(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Exchange rows that the store lacks, as chunks; importing twice changes nothing."""
    new = rows.dropDuplicates(["h"]).join(store.select(F.col("content_hash").alias("h")), "h", "left_anti")
    vector = F.transform(F.split(F.regexp_replace("v", r"[\[\]]", ""), ","), lambda x: x.cast("float"))
    return new.select(F.col("h").alias("content_hash"), F.col("e").alias("embed_text"), F.col("r").alias("raw_text"), F.col("t").alias("token_count"), F.col("m").alias("model_id"), vector.alias("embedding"))


def status(repos: DataFrame, files: DataFrame, locations: DataFrame) -> DataFrame:
    """Per repository: files, live and history locations, distinct chunks, newest index time.

    Each child is aggregated before the join, so nothing multiplies.
    """
    f = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.max("indexed_at").alias("indexed_at"))
    old = F.col("path").startswith(HISTORY)
    n = locations.groupBy("repo").agg(F.count_if(~old).alias("live"), F.count_if(old).alias("history"), F.count_distinct("content_hash").alias("chunks"))
    zero = {c: 0 for c in ("files", "live", "history", "chunks")}
    return repos.select("repo").join(f, "repo", "left").join(n, "repo", "left").na.fill(zero)


def nearest_below(rows: DataFrame, line: int) -> DataFrame:
    """The smallest span of each path that covers a line (ties to the earlier start, then the hash)."""
    covering = rows.where(F.lit(line).between(F.col("start_line"), F.col("end_line")))
    w = Window.partitionBy("path").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "content_hash")
    return covering.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
