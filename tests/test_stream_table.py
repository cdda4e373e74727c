"""Results of a stream in complete mode are a table, not rows in the driver."""

from __future__ import annotations

from lodestone.catalog import QUERIES


def test_debounced_stream_is_read_from_a_table(spark, sf):
    out = QUERIES["stream_debounce"](spark, sf)
    assert out.inputFiles() and not [t.name for t in spark.catalog.listTables() if t.name.startswith("debounce_")]
    batch = QUERIES["debounce_sessions"](spark, sf).drop("reason")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
