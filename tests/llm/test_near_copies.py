"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline

from lodestone.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (text or "").split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows, least=0.8):
    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or len(x & y) >= least * len(x | y) - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k for k in root if root[k] == k}


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def made():
    """Copies with edits around the threshold, a group linked through its base only, a common passage, odd texts."""
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 300]))]
        texts += [" ".join(base), *(" ".join(edited(rng, base, share)) for share in (0.01, 0.02, 0.03, 0.05))]
    base = [f"b{i}" for i in range(100)]
    texts += [" ".join([*base[:at], f"x{at}", f"y{at}", *base[at + 2 :]]) for at in range(0, 98, 2)] + [" ".join(base)]
    passage = [f"p{i}" for i in range(40)]
    texts += [" ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([5, 60])))]) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_drops_edited_copies(spark, sf, monkeypatch):
    rows = made()
    want = brute_kept(rows)
    assert len(want) < len(rows) - 80
    for sample in (near_copies.SAMPLE, 50):
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS), sf).collect()
        assert len(out) == len(want) and {r.doc_id for r in out} == want


def test_stage_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_odd(spark, sf):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "g"), (None, "g"), (7, "h"), (7, "i")]
    out = near_copies.keep_first(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("3", "a b c d e f"), ("7", "h"), ("7", "i"), ("None", "g")]
    assert near_copies.keep_first(spark.createDataFrame([], DOCS)).count() == 0
