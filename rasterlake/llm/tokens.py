"""Lower-cased ASCII words of Arrow string batches, their n-grams, and a table that interns n-grams.

A word is a run of bytes other than 00-2F, 3A-60 and 7B-7F once A-Z are lower-cased: digits, a-z
and all bytes of characters beyond ASCII.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: N-grams interned at a time, so that a text of any length takes a table of bounded size.
OCCURRENCES = 1 << 18


def lower_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and n+1 word offsets of the texts that begin at `at`."""
    raw = _LOWER[raw]
    word = _WORD[raw]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cut = at[(at > 0) & (at < len(raw))]
    begins[cut] |= word[cut]
    ends[cut - 1] |= word[cut - 1]
    s = np.flatnonzero(begins)
    return raw, s, np.flatnonzero(ends) + 1, np.searchsorted(s, at)


def joined(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space between: bytes, and their starts and ends, so that an n-gram is one slice."""
    at = np.concatenate([[0], np.cumsum(e - s + 1)])
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out = np.full(at[-1], 0x20, np.uint8)
    keep = np.zeros(len(raw) + 1, np.int8)
    keep[s] += 1
    keep[e] -= 1  # words that touch, at the border of two texts, cancel out
    out[inside] = raw[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    return out, at[:-1], at[1:] - 1


def ngrams(s: np.ndarray, e: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all runs of lo to hi words of one text, given words of `joined`."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    for n in range(lo, hi + 1):
        m = max(0, len(s) - n + 1)
        same = np.flatnonzero(rows[:m] == rows[n - 1 : n - 1 + m])
        found.append((s[same], e[same + n - 1], rows[same]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _eight(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of each raw[s:e]: those under 32 bytes all at once, step by step; longer ones by the library."""
    n = e - s
    eight = _eight(raw)
    out = np.empty(len(s), np.uint64)
    with np.errstate(over="ignore"):
        acc = _P5 + n.astype(np.uint64)
        at, left = s.copy(), np.where(n < 32, n, 0)
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            acc[i] = _turn(acc[i] ^ (_turn(eight[at[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        acc[i] = _turn(acc[i] ^ ((eight[at[i]] & _LOW[4]) * _P1), 23) * _P2 + _P3
        at[i] += 4
        left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left > 0)
            acc[i] = _turn(acc[i] ^ ((eight[at[i]] & _LOW[1]) * _P5), 11) * _P1
            at[i] += 1
            left[i] -= 1
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        out[:] = acc ^ (acc >> np.uint64(32))
    view = memoryview(raw)
    for i in np.flatnonzero(n >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(view[s[i] : e[i]])
    return out


def equal_slices(raw: np.ndarray, s: np.ndarray, e: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Whether raw[s:e] and raw[s2:e2] are the same bytes."""
    same = (e - s == e2 - s2) & ((s == s2) | (e > s))
    same |= (e == s) & (e2 == s2)
    eight, n = _eight(raw), e - s
    todo = np.flatnonzero(same & (s != s2))
    for k in range(0, 64, 8):
        todo = todo[n[todo] > k]
        if not len(todo):
            return same
        mask = _LOW[np.minimum(n[todo] - k, 8)]
        equal = ((eight[s[todo] + k] ^ eight[s2[todo] + k]) & mask) == 0
        same[todo[~equal]] = False
        todo = todo[equal]
    view = memoryview(raw)
    for i in todo[n[todo] > 64].tolist():
        same[i] = view[s[i] + 64 : e[i]] == view[s2[i] + 64 : e2[i]]
    return same


class Interned:
    """An open-addressed table of the n-grams raw[s:e] of a batch: xxhash64 keys, linear probing, equal keys verified byte by byte.

    `slot` is the slot of each occurrence, `used` the slots in use; by slot, `owner` is an occurrence
    of its n-gram, `count` the number of occurrences and `bucket` the CRC-32 of the bytes modulo
    `buckets`. The table is twice as large as the number of occurrences, so that probing ends.
    """

    def __init__(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        n = len(s)
        keys = xxh64(raw, s, e) if keys is None else keys
        size = 1 << max(4, (2 * n - 1).bit_length())
        self.owner = np.full(size, -1, np.int64)
        self.slot = np.zeros(n, np.int64)
        probe = (keys & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            at = probe[todo]
            free = self.owner[at] < 0
            self.owner[at[free]] = todo[free]  # of several that meet in a free slot, one stays
            owner = self.owner[at]
            same = keys[owner] == keys[todo]
            like = np.flatnonzero(same)
            same[like] = equal_slices(raw, s[todo[like]], e[todo[like]], s[owner[like]], e[owner[like]])
            self.slot[todo[same]] = at[same]
            todo = todo[~same]
            probe[todo] = (probe[todo] + 1) & (size - 1)
        self.used = np.flatnonzero(self.owner >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        view = memoryview(raw)
        who = self.owner[self.used]
        self.bucket[self.used] = [zlib.crc32(view[a:b]) % buckets for a, b in zip(s[who].tolist(), e[who].tolist(), strict=True)]
