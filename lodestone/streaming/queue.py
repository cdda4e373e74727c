"""Path events: bursts are collapsed by a quiet gap, and a large burst becomes a full pass.

A debounce that restarts at every event is a session window whose gap is the quiet time. The reference
time is the event's own; the watermark must be at least the gap. In append mode a session is released
when the watermark passes its end, so the last ones of a stream wait for a later event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Quiet time and the number of pending paths at which a burst overflows.
QUIET, OVERFLOW = "500 milliseconds", 500


def sessions(events: DataFrame, gap: str = QUIET, most: int = OVERFLOW, key: str = "repo", path: str = "path", ts: str = "ts") -> DataFrame:
    """(key, start, end, events, paths, reason): bursts per key, of a batch or of a stream.

    Distinct paths of a burst are collected up to one over ``most``: beyond that it is an overflow, and
    only their number matters.
    """
    out = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.size(F.collect_set(path)).cast("long").alias("paths"))
    reason = F.when(F.col("paths") >= most, "overflow").otherwise("debounce")
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths", reason.alias("reason"))


def distinct_paths(events: DataFrame, key: str = "repo", path: str = "path", ts: str = "ts", gap: str = QUIET) -> DataFrame:
    """One row per key, burst and path: the last event wins."""
    w = events.groupBy(key, path, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))
    return w.select(key, path, "last", "events")


def overflow_runs(events: DataFrame, most: int = OVERFLOW, gap: str = QUIET, key: str = "repo", path: str = "path", ts: str = "ts") -> DataFrame:
    """Flushes that a burst causes if every ``most`` distinct paths flush at once: key, start, flushes."""
    out = sessions(events, gap, most, key, path, ts)
    return out.select(key, "start", F.greatest(F.lit(1), F.ceil(F.col("paths") / most)).cast("long").alias("flushes"))


def watch(stream: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, gap: str = QUIET, most: int = OVERFLOW, watermark: str = "10 seconds", once: bool = True, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Feed finished bursts to ``flush``; an error is reported and does not end the stream.

    Micro-batches run one at a time, and events that arrive meanwhile wait for the next, so none is lost.
    """

    def each(batch: DataFrame, number: int) -> None:
        try:
            flush(batch, number)
        except Exception as e:
            if on_error is None:
                raise
            on_error(e)

    out = sessions(stream.withWatermark("ts", watermark), gap, most)
    writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def whole(out: DataFrame, table: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Keep all rows of an aggregated stream (complete mode) in the Parquet table at ``table``, up to what has arrived now.

    Executors write them; the driver, whose memory a sink of rows would fill, sees none.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    writer = out.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()
