"""Word shingles as 64-bit hashes and one-permutation sketches (numpy, per document).

A document's set is the distinct 5-word shingles of its words; with fewer
words the whole sequence counts as one shingle; without words it is empty.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (uint64 arrays)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is the rule."""
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64) of one text."""
    w = words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        s = s * _MUL + h[i:i + n]
    # the length is part of the hash: a short whole sequence is no prefix of a longer one
    return np.unique(mix64(s + np.uint64(k)))


class OnePermutation:
    """One-permutation MinHash with optimal densification.

    The sorted hashes fall into ``bins`` equal ranges; a bin's value is its
    smallest hash. An empty bin i tries bins ``pick(i, 1), pick(i, 2), ...``
    (the same sequence for every document) and copies the first non-empty one.
    """

    #: Picks are drawn in blocks of this many attempts, without an upper limit.
    BLOCK = 64

    def __init__(self, bins: int):
        self.bins = bins
        self._blocks: list[np.ndarray] = []

    def _pick(self, attempt: int) -> np.ndarray:
        b, r = divmod(attempt, self.BLOCK)
        while len(self._blocks) <= b:
            a = np.arange(self.BLOCK, dtype=np.uint64)[:, None] + np.uint64(len(self._blocks) * self.BLOCK)
            i = np.arange(self.bins, dtype=np.uint64)[None, :]
            self._blocks.append((mix64((a + np.uint64(1)) * _MUL + i * _MIX2)
                                 % np.uint64(self.bins)).astype(np.int64))
        return self._blocks[b][r]

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """``bins`` values of a sorted, non-empty uint64 array."""
        pos = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.empty(len(pos), dtype=bool)
        first[0] = True
        np.not_equal(pos[1:], pos[:-1], out=first[1:])
        out = np.zeros(self.bins, dtype=np.uint64)
        full = np.zeros(self.bins, dtype=bool)
        at = pos[first].astype(np.int64)
        out[at] = hashes[first]
        full[at] = True
        empty = np.flatnonzero(~full)
        attempt = 0
        while len(empty):
            to = self._pick(attempt)[empty]
            ok = full[to]
            out[empty[ok]] = out[to[ok]]
            empty = empty[~ok]
            attempt += 1
        return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` sketch values (the band number is part of it)."""
    m = sketch.reshape(-1, rows)
    k = np.arange(1, len(m) + 1, dtype=np.uint64) * _MIX
    for i in range(rows):
        k = mix64(k * _MUL + m[:, i])
    return k.view(np.int64)
