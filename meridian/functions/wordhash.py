"""Hashes of words and of sequences of words, in batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit depends on every other."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Words:
    """Hashes of the words of some texts, end to end. Words are parted by single blanks; a null text is as an empty one."""

    _hashes: dict[str, int] = {}

    def __init__(self, texts: pa.Array | list[str]):
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.fill_null(column, ""), " ")
        words = lists.flatten().dictionary_encode()
        if len(self._hashes) > 1_000_000:
            self._hashes.clear()
        known = self._hashes
        distinct = []
        for w in words.dictionary.to_pylist():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            distinct.append(h)
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes = np.array(distinct, dtype=np.uint64)[words.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.uint64)

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every sequence of q words; a text with fewer words has none."""
        n = len(self.hashes) - q + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(q):
            h = h * MULTIPLIER + self.hashes[j : j + n]
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inside = owner[:n] == owner[q - 1 : q - 1 + n]
        return mix(h[inside]), owner[:n][inside]
