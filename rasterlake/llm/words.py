"""Vectorised word splitting and hashing over Arrow string batches.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes, so a whole Arrow batch is
split in a few numpy passes over its one data buffer; no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first i bytes of 8.
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Bytes of text worked on at a time; a longer document is a block alone, and its words are hashed
#: part by part, so that what is held for it is a few numbers a word and not a byte.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a pair in order."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets; a null is an empty text."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = texts.type in (pa.large_string(), pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _cuts(raw: np.ndarray) -> list[int]:
    """Ends of parts of about BLOCK_BYTES that start with white space, so that no word is cut."""
    cuts, look = [0], 1 << 16
    at = BLOCK_BYTES
    while at < len(raw):
        found = np.flatnonzero(_SPACE[raw[at : at + look]])
        if len(found):
            cuts.append(at + int(found[0]))
            at = cuts[-1] + BLOCK_BYTES
        else:
            at += look
    return [*cuts, len(raw)]


def hash_slices(raw: np.ndarray, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each raw[s:e]: its blocks of 8 bytes, each mixed with its place first, then added and mixed with the length.

    Slices of up to 8 bytes and one length never meet. Another `salt` is another function.
    """
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))  # the 8 bytes from each place on
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, ((int(n.max()) + 7) >> 3) + 1, dtype=np.uint64) * _BASE + np.uint64(salt))
        total = mix((eight[s] & _LOW[np.minimum(n, 8)]) ^ key[0])
        longer = np.flatnonzero(n > 8)
        if len(longer):
            more = (n[longer] - 1) >> 3
            ends = np.cumsum(more)
            j = np.arange(ends[-1]) - np.repeat(ends - more, more) + 1
            at = np.repeat(s[longer], more) + 8 * j
            block = eight[at] & _LOW[np.minimum(np.repeat(e[longer], more) - at, 8)]
            total[longer] += np.add.reduceat(mix(block ^ key[j]), ends - more)
        return mix(total ^ (n.astype(np.uint64) * _BASE))


def split_words(raw: np.ndarray, at: np.ndarray, lower: bool = False, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, byte starts and ends, and n+1 word offsets of the documents."""
    cuts = _cuts(raw)
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        inside = at[np.searchsorted(at, a, side="right") : np.searchsorted(at, b)] - a
        part = _LOWER[raw[a:b]] if lower else raw[a:b]
        s, e = _bounds(part, inside)
        parts.append((hash_slices(part, s, e, salt), s + a, e + a) if a else (hash_slices(part, s, e, salt), s, e))
    hashes, s, e = parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts, strict=True)]
    return hashes, s, e, np.searchsorted(s, at)


def _bounds(raw: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[raw]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[cut] |= word[cut]
    ends[cut - 1] |= word[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_numbers(raw: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A number of each word, the same for the same bytes only."""
    data, at = spaced(_LOWER[raw] if lower else raw, s, e)
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy()


def spaced(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space behind each, and n+1 places: words i to j alone are out[at[i] : at[j] - 1]."""
    at = np.concatenate([[0], np.cumsum(e - s + 1)])
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out = np.full(at[-1], 0x20, np.uint8)
    out[inside] = raw[~_SPACE[raw]]
    return out, at


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values data[start:end]."""
    size = ends - starts
    stop = np.cumsum(size)
    take = np.repeat(starts - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[take].tobytes())])


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, slice of rows) of at most `limit` bytes each, single longer texts alone."""
    _, at = text_buffer(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, and the document's row of each."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = hashes[:n]
    for i in range(1, k):
        out = combine(out, hashes[i : n + i])
    same = rows[:n] == rows[k - 1 :]
    return out[same], rows[:n][same]
