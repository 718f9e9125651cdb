"""A compressed full-text index over words: backward search on a wavelet matrix of the Burrows-Wheeler transform, in numpy."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed into 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of the `depth` symbols from them on, or more; by doubling."""
    n = len(text)
    rank, order, known = text.astype(np.int64), None, 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if known < n:
            second[:-known] = rank[known:] + 1
        key = rank * (n + 2 + int(text.max(initial=0))) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        known *= 2
        if known >= depth or rank[order[-1]] == n - 1:
            return order


class FmIndex:
    """An index over strings of whole numbers, each with a value; depth: longest pattern that is searched.

    Strings lie on end, with a separator behind each that no pattern holds, so no match crosses strings. Rows are ordered
    by the first `depth` symbols and more, which is what backward search of patterns of that length needs.
    """

    def __init__(self, strings: np.ndarray, bounds: np.ndarray, values: np.ndarray, depth: int):
        lengths = np.diff(bounds)
        self.symbols, coded = np.unique(strings, return_inverse=True)
        text = np.zeros(len(strings) + len(lengths), dtype=np.int64)
        text[np.arange(len(strings)) + np.repeat(np.arange(len(lengths)), lengths)] = coded + 1
        self.coded, self.bounds = coded + 1, bounds
        order = suffix_order(text, depth)
        self.values = np.concatenate([np.repeat(values, lengths + 1)[order], values[:1]])
        last = text[order - 1]
        counts = np.bincount(text, minlength=len(self.symbols) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, BitVector]] = []
        start = np.zeros(len(counts), dtype=np.int64)
        all_symbols = np.arange(len(counts))
        for bit in reversed(range(max(1, int(len(self.symbols)).bit_length()))):
            bits = (last >> bit & 1).astype(np.uint8)
            vector = BitVector(bits)
            ones = vector.ones(start)
            start = np.where(all_symbols >> bit & 1, vector.zeros + ones, start - ones)
            self.levels.append((bit, vector))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        #: where rows that begin with a symbol start, less where the matrix puts that symbol
        self.shift = self.first[:-1] - start

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before those of symbol + pattern, given the rows before those of the pattern."""
        for bit, vector in self.levels:
            ones = vector.ones(at)
            at = np.where(symbol >> bit & 1, vector.zeros + ones, at - ones)
        return at + self.shift[symbol]

    def least_values(self, ends: np.ndarray, length: int, fewest: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Which patterns occur in the index `fewest` times or more, and the least value of a string that holds each.

        A pattern is the `length` symbols of the indexed strings that end before a position of `ends`. All are extended to
        the left, a symbol at a time; one leaves as soon as what is matched occurs too rarely.
        """
        kept = np.arange(len(ends))
        symbol = self.coded[ends - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(2, length + 1):
            going = high - low >= fewest
            kept, low, high = kept[going], low[going], high[going]
            symbol = self.coded[ends[kept] - k]
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = both[: len(kept)], both[len(kept) :]
        going = high - low >= fewest
        kept, low, high = kept[going], low[going], high[going]
        if not len(kept):
            return kept, np.zeros(0, dtype=self.values.dtype)
        # rows of patterns of one length are equal or disjoint
        lows, of = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), dtype=np.int64)
        highs[of] = high
        return kept, np.minimum.reduceat(self.values, np.stack([lows, highs], axis=1).ravel())[::2][of]
