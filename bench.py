"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. Each query runs once to warm up on the smallest
tables and once, timed, into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["hybrid_search", "lexical_search", "knn_exact", "knn_fanout", "rrf_nbranch", "subset_sweep", "rerank_fuse", "diversified_topk", "line_pack", "merge_small", "gap_coverage", "changed_files", "missing_hashes", "repo_map_packed", "debounce_sessions", "recall_mrr", "latency_percentiles", "collapse_savings", "code_chunks", "call_map"]


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestone.catalog import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    took = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
