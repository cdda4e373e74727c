"""The near-copy stage's deletion-variant signatures: what they find without the prefix filter behind them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from test_near_copies import DOCS, edited, shingles

from lodestone.llm import near_copies
from lodestone.llm._common import written


def signed(words):
    return [int(w) - 2**64 if int(w) >= 2**63 else int(w) for w in words]


def test_reach_similarity(spark):
    rng = random.Random(6)
    rows, want = [], set()
    while len(want) < 150:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 200, 600]))]
        a, b = " ".join(base), " ".join(edited(rng, base, rng.choice([0.01, 0.02])))
        x, y = shingles(a), shingles(b)
        if x != y and len(x & y) >= 0.8 * len(x | y):
            want.add((len(rows), len(rows) + 1))
            rows += [(len(rows), a, "en", "s", 0), (len(rows) + 1, b, "en", "s", 0)]
    marked = near_copies.with_nodes(spark.createDataFrame(rows, DOCS), 5, "text", "s")
    nodes = written(marked.withColumnsRenamed({"s": "fp", "doc_id": "row"}), "nodes-test")[0]
    found = {tuple(sorted((r.ur, r.vr))) for r in near_copies.by_signatures(nodes).collect()}
    # all but those that chance leaves without a common signature
    assert len(found & want) >= 0.98 * len(want) and len(found - want) <= 3


def test_every_pair_within_31_bits(spark):
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for i in range(0, 400, 2):
        bits = rng.integers(0, 2, 256, dtype=np.uint8)
        other = bits.copy()
        # the worst that 31 bits can do: two in each segment but one
        at = rng.permutation(16)[:15]
        other[np.concatenate([16 * at + rng.integers(0, 8, 15), 16 * at + rng.integers(8, 16, 15), [rng.integers(0, 256)]])] ^= 1
        for k, b in ((i, bits), (i + 1, other)):
            rows.append((k, k, *signed(np.packbits(b, bitorder="little").view(np.uint64))))
        want.add((i, i + 1))
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("fp", "row", *near_copies.FINGERPRINT)))
    assert {tuple(sorted((r.u, r.v))) for r in near_copies.by_signatures(nodes).collect()} == want


def test_crowded_bucket_stays_joined(monkeypatch):
    monkeypatch.setattr(near_copies, "WINDOW", 2)
    rng = np.random.default_rng(8)
    words = np.zeros((60, 4), np.uint64)
    # byte 0 is the cell's, byte 1 the segment's other one; the sets differ elsewhere by a few bits
    words[:, 3] = rng.integers(0, 2**16, 60)
    cols = [np.zeros(60, np.int64), np.arange(60), np.arange(60), *words.T.copy().view(np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cell", "fp", "row", *near_copies.FINGERPRINT])
    root = list(range(60))
    for out in near_copies._nearest(iter([batch.slice(0, 25), batch.slice(25)])):
        for r in out.to_pylist():
            assert r["far"] == int(np.bitwise_count(words[r["u"]] ^ words[r["v"]]).sum()) and (r["v"] > r["u"]) == bool(r["side"])
            low, high = sorted((root[r["u"]], root[r["v"]]))
            root = [low if x == high else x for x in root]
    assert set(root) == {0}
