"""Hashed text features of the two classifiers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from lodestone.llm._common import remembers

#: Words whose hash a worker remembers; then it begins anew. Longer words are not remembered, which bounds the bytes.
REMEMBERED, LONGEST = 400_000, 48
_WORDS = re.compile(r"\w+")


class _Hashes(dict):
    """Word -> 64-bit hash, filled as asked."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = h
        return h


_hashes = _Hashes()
remembers("features", _hashes.clear)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def grams(text: str, bits: int) -> np.ndarray:
    """Hashed words, pairs of neighbours, and pairs with one word skipped, of lower-cased text."""
    words = _WORDS.findall(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    return np.concatenate([h * _A >> shift, (h[:-1] * _B + h[1:] * _A) >> shift, (h[:-2] * _C + h[2:] * _A) >> shift]).astype(np.int64)
