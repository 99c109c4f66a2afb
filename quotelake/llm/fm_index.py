"""A compressed FM-index of word sequences in numpy, and matching statistics of sequences that stream past it.

The index is the Burrows-Wheeler transform of all sequences in a wavelet matrix, bits packed with
block counts, and the places where neighbouring suffixes stop being equal. A sequence is read from its end: each word
is one backward step; when the match is as long as asked for, its last word is let go by widening the
interval to the suffixes that share one word less. All sequences are read side by side.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol at any place of an integer sequence, in one pass per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []  # (shift, packed bits, ones before each 64, zeros of the level)
        current = symbols.astype(np.int32)
        for shift in range(max(int(alphabet - 1).bit_length(), 1) - 1, -1, -1):
            bit = (current >> shift) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(current) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = int(len(current) - bit.sum())
            self.levels.append((shift, words, before, zeros))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.first = self._descend(np.arange(alphabet, dtype=np.int32), np.zeros(alphabet, np.int64))

    def _descend(self, symbol, place):
        for shift, words, before, zeros in self.levels:
            block = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(words[block] & below)
            place = np.where((symbol >> shift) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._descend(symbol, place) - self.first[symbol]


class FmIndex:
    """Index of sequences of symbols 1, 2, ...; finds matches of up to `width` symbols."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, width: int):
        self.width, self.n_symbols = width, int(symbols.max(initial=0)) + 1
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)  # a 0 behind every sequence
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = symbols
        self.owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.suffixes = self._sort(text)
        self.bwt = WaveletMatrix(text[self.suffixes - 1], self.n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])
        self.common = self._common(text)

    def _sort(self, text):
        """Suffixes in the order of their first symbols, at least `width` of them, by prefix doubling."""
        rank, reach, order = text.astype(np.int64), 1, np.argsort(text, kind="stable")
        while reach < self.width and len(text):
            later = np.zeros(len(text), np.int64)
            later[:-reach] = rank[reach:] + 1
            key = rank * (int(rank.max()) + 2) + later
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank[order] = fresh
            reach *= 2
            if fresh[-1] == len(text) - 1:
                break
        return order

    def _common(self, text):
        """Symbols that each suffix shares with the one before it, `width` at most."""
        n = len(text)
        common, same = np.zeros(n, np.int8), np.ones(n, bool)
        same[:1] = False
        for k in range(self.width):
            symbol = text[np.minimum(self.suffixes + k, n - 1)]
            same[1:] &= (symbol[1:] == symbol[:-1]) & (self.suffixes[1:] + k < n) & (self.suffixes[:-1] + k < n)
            common += same
        return common

    def classes(self, length: int):
        """(number of each suffix's class, first suffix of each class and the end) for equal first `length` symbols."""
        fresh = self.common < length
        return np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), len(fresh))

    def matches(self, symbols: np.ndarray, lengths: np.ndarray):
        """Matching statistics: (length, low, high) per symbol of the streamed sequences.

        The longest match, up to `width`, that starts there, and the suffixes that begin with it. A symbol that the index does not
        hold is 0 or lies outside the alphabet.
        """
        ends = np.cumsum(lengths)
        out_length, out_low, out_high = (np.zeros(len(symbols), t) for t in (np.int8, np.int64, np.int64))
        order = np.argsort(-lengths, kind="stable")
        by_length = lengths[order]
        size = len(self.suffixes)
        low, high = np.zeros(len(order), np.int64), np.full(len(order), size)
        matched = np.zeros(len(order), np.int64)
        shorter = {}
        for step in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-by_length, -step, "left"))  # sequences with more than `step` symbols
            at = ends[order[:n]] - 1 - step
            symbol = symbols[at]
            known = (symbol > 0) & (symbol < self.n_symbols)
            todo = np.flatnonzero(known)
            lost = np.flatnonzero(~known)
            low[lost], high[lost], matched[lost] = 0, size, 0
            while len(todo):
                # let go of last symbols: first where the match is full, then where it can't be extended
                full = todo[matched[todo] >= self.width]
                for length in np.unique(matched[full]):
                    self._widen(full[matched[full] == length], self.width - 1, low, high, matched, shorter)
                c = symbol[todo]
                a = self.before[c] + self.bwt.rank(c, low[todo])
                b = self.before[c] + self.bwt.rank(c, high[todo])
                ok = a < b
                done, todo = todo[ok], todo[~ok]
                low[done], high[done] = a[ok], b[ok]
                matched[done] += 1
                for length in np.unique(matched[todo]):  # empty in most steps
                    self._widen(todo[matched[todo] == length], int(length) - 1, low, high, matched, shorter)
            out_length[at], out_low[at], out_high[at] = matched[:n], low[:n], high[:n]
        return out_length, out_low, out_high

    def _widen(self, rows, length, low, high, matched, shorter):
        if length <= 0:
            low[rows], high[rows], matched[rows] = 0, len(self.suffixes), 0
            return
        if length not in shorter:
            shorter[length] = self.classes(length)
        number, starts = shorter[length]
        which = number[low[rows]]
        low[rows], high[rows], matched[rows] = starts[which], starts[which + 1], length
