"""Word shingles of whole texts as sorted arrays of 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of the base from 0 to n - 1, kept and extended as needed."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 2 * len(_powers)), _BASE)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers[:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint64)
    solid = np.concatenate([[False], ~_WHITE[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts[1:]]), np.diff(np.concatenate([[0], starts[1:], [len(data)]])))
    place = np.maximum(place, 0)
    if starts[0]:
        place[: starts[0]] = 0
        place[starts[0] : (starts[1] if len(starts) > 1 else len(data))] -= starts[0]
    value = _OF_BYTE[data] * _power(int(place.max()) + 1)[place]
    value[~solid[1:-1]] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; a shorter text is one shingle, one without words none."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix(total + h[k : len(h) - n + 1 + k])
    return np.unique(total)
