"""Words of many texts at a time, on arrays of bytes: where they stand, and their XXH64."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def word_bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def xxh64_words(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of each ``data[first:end]``, words of one length together.

    From 32 bytes on, where XXH64 works in four lanes, a word goes to the library by itself.
    """
    data = np.append(data, np.zeros(8, np.uint8))
    eights, fours = (np.ndarray((len(data) - width + 1,), f"<u{width}", data, strides=(1,)) for width in (8, 4))
    size = end - first
    out = np.empty(len(first), np.uint64)
    kind = np.minimum(size, 32).astype(np.uint8)
    order = np.argsort(kind, kind="stable")  # bytes are sorted in one pass
    cuts = np.append(0, np.cumsum(np.bincount(kind, minlength=33)))
    for n in range(32):
        rows = order[cuts[n] : cuts[n + 1]]
        if not len(rows):
            continue
        at = first[rows]
        h = np.full(len(rows), P5 + np.uint64(n))
        i = 0
        while n - i >= 8:
            h = _turned(h ^ _turned(eights[at + i] * P2, 31) * P1, 27) * P1 + P4
            i += 8
        if n - i >= 4:
            h = _turned(h ^ fours[at + i].astype(np.uint64) * P1, 23) * P2 + P3
            i += 4
        for j in range(i, n):
            h = _turned(h ^ data[at + j].astype(np.uint64) * P5, 11) * P1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[rows] = h ^ h >> np.uint64(32)
    for row in order[cuts[32] :].tolist():
        out[row] = xxhash.xxh64_intdigest(data[first[row] : end[row]].tobytes())
    return out
