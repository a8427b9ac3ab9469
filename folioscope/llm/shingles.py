"""Words and hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle; no words, none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out) + h[i : len(h) - k + 1 + i] * _U(0x9E3779B97F4A7C15)
    return np.unique(mix(out + _U(k)))
