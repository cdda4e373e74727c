"""The scan for nearest vectors: its memory, and approximate lists without the pairs of a bucket."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions.vector import cosine_distance
from lodestone.operators import knn


def test_a_worker_holds_no_matrix_of_questions_and_rows(spark, monkeypatch):
    made = np.random.default_rng(1).normal(size=(10_000, 8)).astype(np.float32)
    v = spark.createDataFrame([(0, [0.0] * 8)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, made[i].tolist()) for i in range(2048)], "query_id long, vector array<float>")
    scans, run = [], type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, *a, **b: (scans.append(f), run(self, f, *a, **b))[1])
    knn.top_k(v, q, 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(made), pa.list_(pa.float32())), pa.nulls(10_000, pa.string())], names=["i", "v", "x"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in scans[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one matrix of them all has 164 MB
    assert rows == 2048 * 20 and peak < 80e6


def test_ties_at_the_kth_place_and_late_neighbours(spark):
    # every vector comes four times, and the nearest come last
    v = spark.range(3000).selectExpr("id AS vec_id", "array(cast(1 as double), (750 - floor(id / 4)) / 100) AS embedding").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 5.0])], "query_id long, vector array<double>")
    d = F.round(cosine_distance(F.col("embedding"), F.col("vector")), 6) + F.lit(0.0)
    pairs = v.crossJoin(q).select("query_id", "vec_id", d.alias("d")).collect()
    want = [x for n in (0, 1) for x in sorted((r.query_id, r.d, r.vec_id) for r in pairs if r.query_id == n)[:10]]
    assert sorted((r.query_id, r.dist, r.vec_id) for r in knn.top_k(v, q, 10).collect()) == want


def test_approximate_lists_without_pairs_of_buckets(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    got = knn.approximate_top_k(v, q, 10, tables=2, bits=6)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    near = F.explode(F.array(F.col("bucket"), *(F.col("bucket").bitwiseXOR(F.lit(1 << b)) for b in range(6))))
    asked = knn.buckets(q, 2, 6, id_col="query_id", vector_col="vector").withColumn("bucket", near)
    pairs = asked.join(knn.buckets(v, 2, 6), ["table", "bucket"]).select("query_id", "vec_id").distinct().join(v, "vec_id").join(q, "query_id")
    found: dict[int, list] = {}
    for r in pairs.select("query_id", "vec_id", (F.round(cosine_distance(F.col("embedding"), F.col("vector")), 6) + F.lit(0.0)).alias("d")).collect():
        found.setdefault(r.query_id, []).append((r.d, r.vec_id))
    want = [(n, *x) for n in sorted(found) for x in sorted(found[n])[:10]]
    assert sorted((r.query_id, r.dist, r.vec_id) for r in got.collect()) == want
