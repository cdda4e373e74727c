"""The bounded sample of labelled rows that a classifier is fitted on.

Bounded are the labels (so many keys of each, those with the smallest hash), the rows (one for each key
and label, whatever number of rows repeat the key) and the bytes of their features (in order of the hash).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import forget, written

Batches = Iterator[pa.RecordBatch]


def pick(labels: DataFrame, label: Column, id_col: str, each: Callable[[int], int]) -> tuple[DataFrame | None, dict[int, int]]:
    """(k, y) of at most ``each(number of labels)`` keys a label, and the number of keys of every label.

    Null keys and labels are left out, and a repeated pair of key and label counts once.
    """
    known = labels.select(F.col(id_col).cast("long").alias("k"), label.cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in sorted(counts):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(each(len(counts)))
        picked = some if picked is None else picked.unionByName(some)
    return picked, counts


def fit_one(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, features: Callable[[Batches], Batches], columns: str, most_bytes: int, fit: Callable[[Batches], Batches], returns: str) -> list:
    """Run ``fit`` in one task over the features of the picked rows, in the order of the key's hash.

    features: batches (k, y, t) -> (k, y, binary ``columns``). Of several texts of one key the one with the
    smallest features counts. Rows are taken in order while their features stay within ``most_bytes``.
    """
    names = columns.split()
    # picked holds a bounded number of keys
    chosen = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), "k")
    made = chosen.mapInArrow(features, ", ".join(["k long", "y int", *(f"{n} binary" for n in names)]))
    one = made.groupBy("k", "y").agg(F.min(F.struct(*names)).alias("f")).select(F.xxhash64("k").alias("h"), "k", "y", "f.*")
    size = sum((F.length(n) for n in names), F.lit(0)).alias("size")
    rows, path = written(one.withColumn("size", size), "sample")
    # one number a row of a bounded sample
    reach = F.sum("size").over(Window.orderBy("h", "k", "y"))
    last = rows.select("h", "k", "y", reach.alias("reach")).where(F.col("reach") <= most_bytes).agg(F.max(F.struct("h", "k", "y")).alias("m")).first()["m"]
    got = []
    if last is not None:
        kept = rows.where(F.struct("h", "k", "y") <= F.struct(F.lit(last["h"]).cast("long"), F.lit(last["k"]).cast("long"), F.lit(last["y"]).cast("int")))
        got = kept.repartition(1).sortWithinPartitions("h", "k", "y").select("h", "y", *names).mapInArrow(fit, returns).collect()
    forget(docs.sparkSession, path)
    return got
