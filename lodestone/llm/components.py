"""Connected components of links between 64-bit nodes, by alternating large and small stars.

Each round is two aggregations and two joins; links are written to the shared folder between rounds, so
nothing but three numbers a round reaches the driver. A node's links are never gathered: the smallest
neighbour is a partial aggregate, and it comes back by an inner join whose large partitions can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import forget, written


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links point from the larger node u to the smaller v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` with u <> v, any direction -> ``(node, root)`` for every linked node but the roots.

    The root is the smallest node of a component. No link gives an empty table; repeated links count once.
    """
    spark = links.sparkSession
    now, path = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        after, after_path = written(_small(_large(now)), "links")
        forget(spark, path)
        now, path = after, after_path
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
