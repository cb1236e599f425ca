"""An FM-index over numbered words: suffix order, wavelet matrix, backward search, sampled places. All of it works on whole arrays."""

from __future__ import annotations

import numpy as np

#: Every place that is a multiple of this is kept, besides the first of each passage.
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of `text` in order. 0 ends a passage; ends differ from each other, the earlier is the smaller.

    Prefix doubling that sorts again only what is still tied.
    """
    n = len(text)
    ends = text == 0
    key = np.where(ends, np.cumsum(ends), text.astype(np.int64) + n + 1)
    order = np.argsort(key, kind="stable")
    slots, rank, near = np.arange(n), np.empty(n, np.int64), 1
    members, key = order, key[order]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[members] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        tied = ~(new & np.concatenate([new[1:], [True]]))
        if not tied.any():
            return order
        slots, members = slots[tied], members[tied]
        key = (rank[members] << 32) | rank[members + near]  # equal so far, so no end lies between
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[slots] = members
        near *= 2


class Bits:
    """A row of bits that counts those set before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, place: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[place >> 6] + np.bitwise_count(self.words[place >> 6] & below)


class Wavelet:
    """Symbols below 2^depth, level by level: those with a 0 bit first, then those with a 1, each in their order."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels = []
        for shift in range(depth - 1, -1, -1):
            bit = (symbols >> shift) & 1 != 0
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._down(np.arange(1 << depth), np.zeros(1 << depth, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(place)
            place = np.where((symbol >> shift) & 1 != 0, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol stands before place."""
        return self._down(symbol, place) - self.first[symbol]

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place, and how often it stands before it."""
        symbol = np.zeros(len(place), np.int64)
        for _, bits, zeros in self.levels:
            one, ones = bits.at(place), bits.rank(place)
            symbol = symbol * 2 + one
            place = np.where(one, zeros + ones, place - ones)
        return symbol, place - self.first[symbol]


class FMIndex:
    """Index over `text`: numbers from 1 to `most`, 0 after each passage, the last one included."""

    def __init__(self, text: np.ndarray, most: int):
        order = suffix_order(text)
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), max(1, int(most).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        begins = np.concatenate([[True], text[:-1] == 0])
        kept = begins[order] | (order % SAMPLE == 0)
        self.kept, self.places = Bits(kept), order[kept]

    def ranges(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to of each pattern's rows, by backward search. patterns: a row each, its words at the end."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.smaller[-1])
        for k in range(patterns.shape[1]):
            at = np.flatnonzero((sizes > k) & (hi > lo))
            if not len(at):
                break
            word = patterns[at, -1 - k].astype(np.int64)
            lo[at] = self.smaller[word] + self.wavelet.rank(word, lo[at])
            hi[at] = self.smaller[word] + self.wavelet.rank(word, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows in the text: back to the next kept place, which lies in the same passage."""
        out, open_, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            done = self.kept.at(rows)
            out[open_[done]] = self.places[self.kept.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, before = self.wavelet.symbol_and_rank(rows)
            rows, steps = self.smaller[symbol] + before, steps + 1
        return out
