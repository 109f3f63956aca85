"""Word shingles of whole texts, as sets of 64-bit hashes.

Words are what stands between ASCII white space, with A-Z lower-cased.  A text's set holds
its distinct runs of five words; a shorter text has its whole sequence as one shingle and a
text without words has none.  Two shingles are taken as equal when their 64-bit hashes
are: within one pair of texts of a million words a chance meeting has odds below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
CACHE_WORDS = 400_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _stir(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words, so that low and high bits are both usable."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, _WordHashes()

    def distinct(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of one text."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        k = self.width if len(words) >= self.width else len(words)
        n = len(words) - k + 1
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out = out * _PRIME + h[i : i + n]
        out = _stir(out)
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def texts_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches in small slices, so that few texts are Python strings at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, part.column("text").to_pylist()
