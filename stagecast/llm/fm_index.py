"""FM-index over words with a wavelet tree, in NumPy, for many searches at a time.

The text of an index is a list of segments, each a list of word numbers from 1; number 0 ends a
segment. Suffixes are compared up to the end of their segment. The Burrows-Wheeler transform is
kept as a wavelet matrix: one packed bit vector per bit of a word number, with running counts.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits; ``ones(i)`` counts those before ``i``, for an array of positions."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view(np.uint64)
        self._before = np.r_[0, np.cumsum(np.bitwise_count(self._words), dtype=np.int64)[:-1]].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & below)


class WaveletMatrix:
    """Rank of any symbol at any position, in one step per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self._shifts = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self._levels, rest = [], symbols
        for shift in self._shifts:
            bits = ((rest >> shift) & 1).astype(np.uint8)
            self._levels.append((BitVector(bits), len(bits) - int(bits.sum())))
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])
        every = np.arange(n_symbols)
        self._start = self._map(every, np.zeros(n_symbols, np.int64))

    def _map(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, (bits, zeros) in zip(self._shifts, self._levels):
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``i``."""
        return self._map(symbol, i) - self._start[symbol]


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    step = np.r_[False, key[order][1:] != key[order][:-1]]
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(step)
    return ranks


class FMIndex:
    """Index of ``segments`` for matches of ``window`` words, each with the smallest ``value`` of its segments."""

    def __init__(self, segments: list[np.ndarray], values: np.ndarray, window: int, n_symbols: int):
        self.window = window
        lengths = np.array([len(s) for s in segments])
        text = np.zeros(int(lengths.sum()) + len(segments), np.int64)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.concatenate(segments) if segments else []
        owner = np.repeat(np.arange(len(segments)), lengths + 1)
        left = ends[owner] - np.arange(len(text))  # words up to the end of the segment
        at = np.arange(len(text))

        def joined(first: np.ndarray, second: np.ndarray, by: int) -> np.ndarray:
            """Rank of ``first`` here, then ``second`` ``by`` words on, if the segment goes that far."""
            after = np.where(left >= by, second[np.minimum(at + by, len(text) - 1)] + 1, 0)
            return _ranked(first * (len(text) + 2) + after)

        rank, span, exact = _ranked(text), 1, {}
        while span <= int(lengths.max(initial=0)):
            for size in (window, window - 1):
                if span <= size < 2 * span:
                    exact[size] = rank if size == span else joined(rank, rank, size - span)
            rank, span = joined(rank, rank, span), 2 * span
        order = np.argsort(rank, kind="stable")  # equal suffixes in the order of their segments
        self._first = np.searchsorted(text[order], np.arange(n_symbols + 1))
        self._bwt = WaveletMatrix(text[order - 1], n_symbols)
        self._runs = {}
        for size in (window, window - 1):
            klass = np.where(left >= size, exact.get(size, rank) + 1, -at)[order]
            marks = np.flatnonzero(np.r_[True, klass[1:] != klass[:-1]])
            number = np.repeat(np.arange(len(marks)), np.diff(np.r_[marks, len(order)]))
            self._runs[size] = (marks, np.r_[marks[1:], len(order)], number)
        self._least = np.minimum.reduceat(values[owner][order], self._runs[window][0]) if len(order) else values

    def extend(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the matches with ``word`` before them."""
        base = self._first[word]
        return base + self._bwt.rank(word, lo), base + self._bwt.rank(word, hi)

    def statistics(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each query the smallest value of a segment that holds it, or -1.

        All queries run backwards together. A match of a whole window is shortened by its last
        word, which widens its interval to the suffixes that share the other words, and goes on.
        Where no suffix goes on with the next word, the match starts anew one word further.
        """
        window, size = self.window, len(self._first) - 1
        lengths = np.array([len(q) for q in queries], np.int64)
        flat = np.concatenate(queries) if queries else np.empty(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - window + 1, 0)
        out = np.full(int(counts.sum()), -1, np.int64)
        out_at = np.cumsum(counts) - counts
        # (query, last word of the match, next word to the left) of every running search
        active = np.flatnonzero(lengths >= window)
        end, at = lengths[active] - 1, lengths[active] - 1
        lo, hi = np.zeros(len(active), np.int64), np.full(len(active), len(self._runs[window][2]))
        while len(active):
            word = flat[starts[active] + at]
            known = (word > 0) & (word < size)
            lo, hi = self.extend(lo, hi, np.where(known, word, 0))
            fits, full = known & (lo < hi), end - at + 1 == window
            hit = np.flatnonzero(fits & full)
            if len(hit):
                marks, ends, number = self._runs[window]
                out[out_at[active[hit]] + at[hit]] = self._least[number[lo[hit]]]
            shorter = self._runs[window - 1]
            wide = shorter[2][np.minimum(lo, len(shorter[2]) - 1)]
            drop = fits & full
            lo, hi = np.where(drop, shorter[0][wide], lo), np.where(drop, shorter[1][wide], hi)
            end, at = np.where(drop, end - 1, end), at - 1
            # A failed match ends one word earlier and is searched from there.
            end = np.where(fits, end, end - 1)
            at = np.where(fits, at, end)
            lo, hi = np.where(fits, lo, 0), np.where(fits, hi, len(shorter[2]))
            going = (end >= window - 1) & (at >= 0)
            active, end, at, lo, hi = (x[going] for x in (active, end, at, lo, hi))
        return np.split(out, out_at[1:]) if len(queries) else []
