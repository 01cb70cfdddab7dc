"""Word shingles of a text as a set of 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_WORDS_KEPT = 1 << 17
# odd multipliers, one per place in a shingle
_PLACES = np.array(
    [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xC2B2AE3D27D4EB4F) & (2**64 - 1) | 1
     for i in range(SHINGLE_WORDS + 1)],
    dtype=np.uint64,
)
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A 64-bit number per word; words met before are looked up."""
    if len(_known) > _WORDS_KEPT:
        _known.clear()
    known = _known
    try:
        return np.array([known[w] for w in words], dtype=np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingles of a UTF-8 text: runs of five words, lower-cased in
    A-Z and split at ASCII white space; a text of fewer words is one shingle; a text
    without words has none."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.empty(0, dtype=np.uint64)
    numbers = word_numbers(words)
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64) * _PLACES[SHINGLE_WORDS]
    for i in range(width):
        total += mix(numbers[i : i + n] * _PLACES[i])
    return np.unique(mix(total))
