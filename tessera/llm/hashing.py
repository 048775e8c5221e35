"""Word and shingle hashes of whole batches of texts, as numpy arrays.

A word's hash is the sum of one random 64-bit value for each (byte, position); a shingle's
is a mix of its words' hashes in order. Two different words or shingles collide with
probability 2**-64.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(DEPTH * 256, dtype=np.uint64))


def words(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (len(texts) + 1)."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    offsets = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    inner = np.flatnonzero(~space)
    begin = np.searchsorted(inner, starts)
    sizes = np.diff(np.append(begin, len(inner)))
    place = np.arange(len(inner)) - np.repeat(begin, sizes)
    key = place * 256 + data[inner]
    values = _TABLE[np.minimum(key, len(_TABLE) - 1)]
    deep = np.flatnonzero(place >= DEPTH)
    if len(deep):
        values[deep] = mix(key[deep].astype(np.uint64))
    return mix(np.add.reduceat(values, begin)), offsets


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive words (len(hashes) - width + 1)."""
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        total = mix(total ^ hashes[k : k + max(n, 0)])
    return total
