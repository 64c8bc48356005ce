"""A compressed FM-index over word ids: a suffix array's BWT and its document array in wavelet matrices, searched backwards in numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64 bits a word and a running count."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """A wavelet matrix: one bit vector per bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, int, Bits]] = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.levels.append((shift, int(len(bit) - bit.sum()), Bits(bit)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a symbol's occurrences before `at` end, in the order of the last level, less `start`."""
        for shift, zeros, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at - start

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The smallest symbol in each range of positions; no range is empty."""
        value = np.zeros(len(start), np.int64)
        for shift, zeros, bits in self.levels:
            a, b = bits.rank(start), bits.rank(end)
            low = end - b > start - a  # some symbol of the range has a 0 here
            value |= np.where(low, 0, 1 << shift)
            start, end = np.where(low, start - a, zeros + a), np.where(low, end - b, zeros + b)
        return value

    def starts(self, sigma: int) -> np.ndarray:
        """Where each symbol starts in the order of the last level."""
        at = np.zeros(sigma, np.int64)
        symbol = np.arange(sigma)
        return self.rank(symbol, np.zeros(sigma, np.int64), at)


def suffix_array(text: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by prefix doubling, and ranks of the suffixes by their first `keep` symbols (a power of two).

    Suffixes must be distinct, as they are where each sequence ends in a symbol of its own.
    """
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    kept, h = rank, 1
    while True:
        if h == keep:
            kept = rank
        if rank.max() == n - 1 and h >= keep:
            return order, kept
        second = np.full(n, -1, np.int64)
        second[: n - h] = rank[h:] if h < n else second[: n - h]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(found[1:] != found[:-1])])
        h *= 2


class FMIndex:
    """Sequences of words, each of an owner, for windows of one length.

    What is kept: the BWT's wavelet matrix, one count a word, the wavelet matrix of the document
    array (the owner of each suffix, in the suffix array's order), and where the intervals of
    suffixes with the same `length` - 1 first words start, the one depth to which a match shrinks.
    The suffix array itself is not kept.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, owners: np.ndarray, length: int) -> None:
        """`words` of all sequences one after another, as numbers; `ends` of each; `owners`, small numbers, one a sequence; `length` is 2 or more."""
        self.length = length
        count = len(ends)
        self.alphabet, ids = np.unique(words, return_inverse=True)
        sizes = np.diff(np.concatenate([[0], ends]))
        owner = np.repeat(owners, sizes + 1)
        text = np.empty(len(words) + count, np.int64)
        stops = ends + np.arange(count)
        inside = np.ones(len(text), bool)
        inside[stops] = False
        text[inside] = ids + count  # words follow the sequences' own end marks
        text[stops] = np.arange(count)
        keep = 1 << ((length - 1).bit_length() - 1)
        order, ranks = suffix_array(text, keep)
        self.n = len(text)
        before = text[order - 1]  # order 0 wraps to the last end mark, which no search uses
        self.wavelet = Wavelet(np.maximum(before - count + 1, 0), len(self.alphabet))
        self.first = self.wavelet.starts(len(self.alphabet) + 1)
        symbols = np.maximum(text - count + 1, 0)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))])
        self.documents = Wavelet(owner[order], int(owner.max(initial=0)))
        size = length - 1  # same first words: the first `keep`, and the `keep` that end with them
        tail = np.full(self.n, -1, np.int64)
        tail[: self.n - (size - keep)] = ranks[size - keep :]
        head, tail = ranks[order], tail[order]
        self.starts = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]), [True]])).astype(np.int32)

    def earliest(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each window of `length` words of streamed sequences, the smallest owner of a sequence that has it.

        Windows follow each other as in the sequences; a window that is nowhere gets the largest
        integer. All sequences are searched backwards at once, a word a step. The match grows to
        `length` words, whose interval of the suffix array the document array then tells the
        smallest owner of; its last word is dropped, which is a step to the interval of the first
        `length` - 1 words. A match that fails starts anew at the end of the next window.
        """
        length = self.length
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        windows = np.maximum(sizes - length + 1, 0)
        out_at = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), np.iinfo(np.int64).max)
        if not len(self.alphabet) or not len(words):
            return out
        found = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[found] == words, found + 1, 0)
        live = np.flatnonzero(windows)
        place = sizes[live] - 1  # the next word, from the right
        end = sizes[live].copy()  # the end of the match
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        while len(live):
            c = symbols[starts[live] + place]
            lo = self.smaller[c] + self.wavelet.rank(c, self.first[c], lo)
            hi = self.smaller[c] + self.wavelet.rank(c, self.first[c], hi)
            ok = (lo < hi) & (c > 0)
            full = ok & (end - place == length)
            hit = np.flatnonzero(full)
            if len(hit):
                out[out_at[live[hit]] + place[hit]] = self.documents.least(lo[hit], hi[hit])
                short = np.searchsorted(self.starts, lo[hit], side="right")
                lo[hit], hi[hit] = self.starts[short - 1], self.starts[short]
            # The window that ends here is done or absent: the next one ends a word further left.
            end = end - (full | ~ok)
            place = np.where(ok, place - 1, end - 1)
            lo, hi = np.where(ok, lo, 0), np.where(ok, hi, self.n)
            stay = (place >= 0) & (end >= length)
            live, place, end, lo, hi = live[stay], place[stay], end[stay], lo[stay], hi[stay]
        return out
