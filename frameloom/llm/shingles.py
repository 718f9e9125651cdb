"""Hashed word shingles of texts, for sketches and similarity joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, and each text's bounds among them, given the hash of each word.

    A text of fewer words, but not of none, has one shingle: all its words.
    """
    n_words = np.diff(bounds)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    length = np.repeat(np.minimum(n_words, size), n)
    rolled = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        inside = length > k
        at = np.minimum(first + k, len(hashes) - 1) if len(hashes) else first
        rolled = np.where(inside, rolled * _STEP + hashes[at] if len(hashes) else rolled, rolled)
    return mixed(rolled + length.astype(np.uint64)), out_bounds


def minima(values: np.ndarray, bounds: np.ndarray, multiplier: int, add: int) -> np.ndarray:
    """The least of values * multiplier + add over each range of bounds, 32 bits; the largest value over an empty one."""
    out = np.full(len(bounds) - 1, 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if len(filled):
        # the upper half of a 64-bit product is as good as random for an odd multiplier
        hashed = ((values * np.uint64(multiplier) + np.uint64(add)) >> np.uint64(32)).astype(np.uint32)
        out[filled] = np.minimum.reduceat(hashed, bounds[filled])
    return out
