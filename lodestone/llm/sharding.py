"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair gets a uniform number u in (0, 1) from MD5; the record goes to the shard with the
least -ln(u) / weight. A further shard can only win records for itself, so growing from n to n + 1
shards moves about weight/total of the records and all of them into the new shard.

Everything is a column expression. Slots (a gapless number within each shard) do not sort a shard in one
task: rows are counted per (shard, bucket), bucket totals become offsets, and rows are numbered inside
their bucket.

Cases: a null key hashes like the empty string; null text has size 1 and checksum 0; repeated rows are
counted before the shuffle and expanded after it, so one key may hold any part of the table; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in which the rows of a shard are numbered (three hex digits of MD5); offsets are shards x BUCKETS rows.
BUCKETS = 16**3
#: Repeated rows that one task expands at once.
CHUNK = 65_536


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) fixed by key and shard: 52 bits of MD5, centred so that it is never 0."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def _bucket() -> Column:
    row = F.concat_ws(":", F.coalesce(F.col("k").cast("string"), F.lit("")), "size", "crc")
    return F.conv(F.substring(F.md5(row), 1, 3), 16, 10).cast("int")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (position in ``weights``) that wins ``key``; ties go to the smaller position."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((-F.log(_unit(text, s)) / F.lit(float(w))).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["s"].cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to a shard and a slot in it, and say where it goes with one more shard.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard`` under the law ``key``: the key
    and the shards alone decide.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("k"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"))
    same = rows.groupBy("k", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    placed = same.select("*", rendezvous(F.col("k"), weights).alias("shard"), rendezvous(F.col("k"), [*weights, grown_weight]).alias("grown"), _bucket().alias("bucket"))
    inside = Window.partitionBy("shard", "bucket").orderBy("k", "size", "crc")
    before = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    totals = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    # offsets: at most len(weights) * BUCKETS rows of three numbers, whatever the input
    numbered = placed.withColumn("before", before).join(F.broadcast(offsets) if len(weights) * BUCKETS <= 1_000_000 else offsets, ["shard", "bucket"])
    first = F.col("offset") + F.col("before")
    out = [F.col("k").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard"]
    once = numbered.where(F.col("n") == 1).select(*out, first.cast("long").alias("slot"), F.col("grown").alias("grown_shard"))
    parts = numbered.where(F.col("n") > 1).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))))
    spread = parts.repartition(F.col("k"), F.col("part"))
    last = F.least(F.col("n") - 1, (F.col("part") + 1) * CHUNK - 1)
    many = spread.withColumn("at", F.explode(F.sequence(F.col("part") * CHUNK, last))).select(*out, (first + F.col("at")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))
    return once.unionByName(many)


#: DuckDB SQL for ``shard`` with eight equal shards and one more.
SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
h AS (
  SELECT d.*, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    list_transform(range(9), lambda s: {'d': -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0), 's': s}) AS scores
  FROM d, crc_table),
p AS (
  SELECT doc_id, size, text_crc32, list_min(scores[1:8]).s AS shard, list_min(scores).s AS grown_shard,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), 1, 3))::INT AS bucket FROM h)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM p
"""
