"""What workers keep in memory is bounded in bytes, and boundaries are read in slices."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import _common, elias_fano, piece_bpe


def test_slices_of_elias_fano():
    v = np.cumsum(np.random.default_rng(3).integers(0, 5000, 3000)).astype(np.uint64)
    v[1000:1700] = v[1000]  # empty documents
    v = np.sort(v)
    e = elias_fano.EliasFano.encode(v)
    for a, b in [(0, 1), (0, 3000), (255, 257), (256, 1024), (999, 1701), (2999, 3000)]:
        assert (e.between(a, b) == v[a:b]).all()
    with pytest.raises(IndexError):
        e.between(5, 3001)


def test_segment_is_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(elias_fano, "SLICE", 3)
    rows = [(None, "x"), (None, "y"), *((k, "word " * (k % 4)) for k in range(1, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    segments = elias_fano.write_segments(docs, public_tokenizers.path("byte_bpe_50k.json"), partitions=1)
    got = sorted(elias_fano.read_segments(segments).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, *range(1, 40)] and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    (data,) = [r.data for r in segments.collect()]
    seg = elias_fano.Segment(bytes(data))
    assert [seg.keys(a, a + 1)[0] for a in range(41)] == seg.keys(0, 41) == [None, None, *range(1, 40)]
    assert [len(seg.document(i)) for i in range(41)] == [r.n_tokens for r in got]


def test_long_strings_are_not_remembered():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = np.random.default_rng(7)
    long = ["".join(rng.choice(list("abcXYZ019+/漢字"), 5000)) for _ in range(3)]
    batch = [f"the {x} and {x}" for x in long] + [f"the  {x}\t{x}" for x in long]
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, lib = elias_fano.Encoder(path), Tokenizer.from_file(path)
    for t, got in zip(batch, enc.encode(batch), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert max(map(len, [*enc.known, *enc.pieces])) <= elias_fano.LONGEST
    path = public_tokenizers.path("piece_bpe_32k.model")
    m, lib = piece_bpe.PieceBpe(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in batch:
        assert m.encode(t) == ",".join(map(str, lib.encode(t))) and m.decode(m.cuts(t)) == lib.decode(lib.encode(t))
    assert max(map(len, [*m.known, *m.words])) <= piece_bpe.LONGEST and max(map(len, m.decoded)) <= 6 * piece_bpe.LONGEST


def test_a_cluster_needs_a_shared_folder():
    class Away:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Away()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session())
