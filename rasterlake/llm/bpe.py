"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.words import blocks

#: Bytes of text split at a time, and of new pre-tokens merged at a time. One longer text is split in
#: runs of pre-tokens; one longer pre-token is merged by itself, since no cut of it is safe.
TEXT_BYTES, MERGE_BYTES, RUN = 4 << 20, 1 << 20, 200_000
#: Positions of a bucket up to which a loop is faster than arrays.
FEW = 8


class RankQueue:
    """Positions by merge rank: one bucket a rank, and three levels of bitmaps over the ranks.

    The least rank with a bucket is three find-first-set steps away, however many positions wait.
    """

    def __init__(self, n_ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (n_ranks // 4096 + 1)
        self.top = 0

    def bucket(self, rank: int) -> list[int]:
        """The bucket of a rank; a new one is marked on all levels."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        return found

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank with a bucket, and its positions."""
        top = self.top
        if not top:
            return None
        m = (top & -top).bit_length() - 1
        x = self.mid[m]
        a = (m << 6) + (x & -x).bit_length() - 1
        y = self.low[a]
        rank = (a << 6) + (y & -y).bit_length() - 1
        self.low[a] = y = y & (y - 1)
        if not y:
            self.mid[m] = x = x & (x - 1)
            if not x:
                self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


class Merger:
    """Merges many pre-tokens with one queue.

    The pre-tokens lie behind each other in one linked list, a mark between any two. A rank's bucket
    is taken whole: its positions in different pre-tokens do not concern each other, and those in
    one are taken from the left. An entry whose pair a merge has changed since is stale and skipped.
    A merge should only make pairs of higher ranks, as the tables of trained vocabularies do; where
    one does not, the lower rank goes first, for which the pre-tokens are merged again one position at a time.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.get = ranks.get
        self.size = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(self.size)
        pairs = [(a, b, rank) for token, rank in ranks.items() for cut in range(1, len(token)) if (a := self.get(token[:cut])) is not None and (b := self.get(token[cut:])) is not None]
        left, right, value = np.array(sorted(pairs) or [(0, 0, 0)], np.int64).T
        self.keys = np.append(left * (self.size + 1) + right + 1, np.iinfo(np.int64).max)
        self.values = np.append(value, -1).astype(np.int32)
        self.of_byte = np.array([self.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.of_two = np.array([self.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 for none; the mark between pre-tokens is symbol -1 and has none."""
        key = left.astype(np.int64) * (self.size + 1) + right + 1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], np.int32(-1))

    def merge(self, pieces: list[bytes], in_bulk: bool = True) -> list[bytes]:
        """Ids of each pre-token as little-endian uint32 bytes: always the pair of least rank, leftmost first."""
        if not pieces:
            return []
        data = b"\0" + b"\0".join(pieces) + b"\0"
        marks = np.cumsum(np.array([0, *map(len, pieces)]) + 1) - 1
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        sym = self.of_byte[raw]
        sym[marks] = -1
        pair = np.full(n, -1, np.int32)
        both = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        pair[both] = self.of_two[raw[both].astype(np.int32) << 8 | raw[both + 1]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        queue, first = self.queue, {}
        order = np.flatnonzero(pair >= 0).astype(np.int32)
        order = order[np.argsort(pair[order], kind="stable")]
        if len(order):
            cuts = np.flatnonzero(np.diff(pair[order])) + 1
            for part in np.split(order, cuts):
                rank = int(pair[part[0]])
                first[rank] = part
                queue.bucket(rank)
        views = tuple(map(memoryview, (sym, pair, after, before)))
        while (found := queue.pop()) is not None:
            rank, late = found
            early = first.pop(rank, order[:0])
            if not in_bulk or len(early) + len(late) <= FEW:
                self._one_by_one(rank, sorted(early.tolist() + late), data, *views)
                continue
            at = np.sort(np.concatenate([early, np.array(late, np.int32)])) if late else early
            if not self._at_once(rank, at, sym, pair, after, before):
                self.queue = RankQueue(self.size)
                return self.merge(pieces, False)
        alive = sym >= 0
        ends = np.cumsum(alive)[marks] * 4
        ids = sym[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _one_by_one(self, rank: int, at: list[int], data: bytes, sym, pair, after, before) -> None:
        get, bucket = self.get, self.queue.bucket
        for done, i in enumerate(at, 1):
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[j]
            sym[i], sym[j], pair[j], after[i], before[end] = rank, -2, -1, end, i
            new = get(data[i : after[end]], -1) if sym[end] >= 0 else -1
            pair[i] = new
            if new >= 0:
                bucket(new).append(i)
            k, newer = before[i], -1
            if sym[k] >= 0:
                pair[k] = newer = get(data[k:end], -1)
                if newer >= 0:
                    bucket(newer).append(k)
            if 0 <= new < rank or 0 <= newer < rank:  # the lower rank first
                if done < len(at):
                    bucket(rank).extend(at[done:])
                return

    def _at_once(self, rank: int, at: np.ndarray, sym: np.ndarray, pair: np.ndarray, after: np.ndarray, before: np.ndarray) -> bool:
        """False if a lower rank came up."""
        at = at[pair[at] == rank]
        if not len(at):
            return True
        j = after[at]
        overlap = j[:-1] == at[1:]
        if overlap.any():  # of pairs that share symbols in a row, the first, third, ...
            place = np.arange(len(at))
            begins = np.where(np.concatenate([[True], ~overlap]), place, 0)
            keep = (place - np.maximum.accumulate(begins)) % 2 == 0
            at, j = at[keep], j[keep]
        end = after[j]
        touch = end[:-1] == at[1:]
        touches = touch.any()
        if touches:
            between = self._rank(np.full(int(touch.sum()), rank), sym[end[:-1][touch]])
            if ((between >= 0) & (between < rank)).any():
                return False
        sym[at], sym[j], pair[j], after[at], before[end] = rank, -2, -1, end, at
        k = before[at]
        if touches:
            k = k[np.concatenate([[True], ~touch])]
        changed = np.concatenate([at, k])
        new = self._rank(sym[changed], sym[after[changed]])
        pair[changed] = new
        good = new >= 0
        new = new[good]
        if not len(new):
            return True
        if new.min() < rank:
            return False
        buckets, bucket = self.queue.buckets, self.queue.bucket
        for r, i in zip(new.tolist(), changed[good].tolist(), strict=True):
            found = buckets.get(r)
            (bucket(r) if found is None else found).append(i)
        return True


class Tokenizer:
    """Encodes by a rank table, as the public tiktoken format defines it.

    Ids of the pre-tokens met lately are kept, in two generations of at most some `cache` each.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 250_000) -> None:
        self.pattern = regex.compile(pattern, regex.V0)
        self.ranks, self.limit = ranks, cache
        self.merger = Merger(ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []  # known for one block only

    def _learn(self, pieces: set[str]) -> None:
        for p in self.long:
            del self.known[p]
        self.long = []
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, waiting, size = self.known, [], 0
        for p in pieces.difference(known):
            ids = self.older.get(p)
            if ids is None:
                b = p.encode()
                if (whole := self.ranks.get(b)) is None:
                    waiting.append((p, b))
                    size += len(b) + 1
                    if size >= MERGE_BYTES:
                        self._merge(waiting)
                        waiting, size = [], 0
                    continue
                ids = whole.to_bytes(4, "little")
            known[p] = ids
        self._merge(waiting)

    def _merge(self, waiting: list[tuple[str, bytes]]) -> None:
        for (p, _), ids in zip(waiting, self.merger.merge([b for _, b in waiting]), strict=True):
            self.known[p] = ids
            if len(p) > 64:
                self.long.append(p)

    def _ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts are some `TEXT_BYTES` together, or one longer text."""
        if len(texts) == 1 and len(texts[0]) > TEXT_BYTES // 4:
            found, out = self.pattern.finditer(texts[0]), []
            while run := [m.group() for m in islice(found, RUN)]:
                self._learn(set(run))
                out.append(self._ids(run))
            return [np.frombuffer(b"".join(out), "<u4")]
        split = [self.pattern.findall(t) for t in texts]
        self._learn(set().union(*split))
        return [np.frombuffer(self._ids(p), "<u4") for p in split]


class Table:
    """Byte strings by index, joined for whole arrays of indexes at once."""

    def __init__(self, words: list[bytes]) -> None:
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def parts(self, ids: np.ndarray, step: int = 1 << 18) -> Iterator[bytes]:
        for i in range(0, len(ids), step):
            some = ids[i : i + step]
            size = self.size[some]
            ends = np.cumsum(size)
            if ends[-1]:
                yield self.data[np.repeat(self.start[some] - ends + size, size) + np.arange(ends[-1])].tobytes()


def bytes_table(ranks: dict[bytes, int]) -> Table:
    """The bytes of each id."""
    words = [b""] * (max(ranks.values(), default=0) + 1)
    for b, i in ranks.items():
        words[i] = b
    return Table(words)


def decimal_table(ranks: dict[bytes, int]) -> Table:
    """Each id in decimal digits, with a comma."""
    return Table([b"%d," % i for i in range(max(ranks.values(), default=0) + 1)])


def _digest(parts: Iterator[bytes], last: bytes = b"") -> str:
    sha = hashlib.sha256()
    for p in parts:
        sha.update(p)
    sha.update(last)
    return sha.hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and the rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_WORKER: dict = {}


def _kept(kind: str, shared, make):
    """What a Python worker made of one vocabulary, so that it outlives a task; the last one of each kind."""
    key = getattr(shared, "id", None) or id(shared)
    if _WORKER.get(kind, (None,))[0] != key:
        _WORKER[kind] = (key, make(shared.value))
    return _WORKER[kind][1]


def _broadcast_ranks(spark: SparkSession, ranks_path: str):
    # A vocabulary file: under 2 MB for the 50k ranks here, whatever the corpus holds.
    return spark.sparkContext.broadcast(read_ranks(ranks_path))


def _encoded(batch: pa.RecordBatch, tokenizer: Tokenizer) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Blocks of the rows of a batch (id, text): the ids of the rows, and their tokens."""
    for start, texts in blocks(batch.column(1), TEXT_BYTES):
        yield batch.column(0).slice(start, len(texts)), tokenizer.encode([t or "" for t in texts.to_pylist()])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `ids array<int>` of every whole text, one row per input row.

    A null or empty text has no ids. Repeated rows are encoded each by itself; other columns of
    `docs` are left out, so their names cannot clash. No shuffle: a lost task is run again.
    """
    shared = _broadcast_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _kept(f"encode {pattern}", shared, lambda ranks: Tokenizer(ranks, pattern))
        for batch in batches:
            for names, ids in _encoded(batch, tokenizer):
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and `decoded binary`; null ids decode to no bytes."""
    shared = _broadcast_ranks(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _kept("bytes", shared, bytes_table)
        for batch in batches:
            out = [b"".join(table.parts(np.array(x or [], np.int64))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes every whole text: `n_tokens`, `ids_sha256`, `decoded_sha256` per row.

    Digests stand for the ids and bytes, so that a corpus can be compared with another encoder's
    output without moving either. Null and empty texts: 0 tokens, digests of no bytes.
    """
    shared = _broadcast_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _kept(f"encode {pattern}", shared, lambda ranks: Tokenizer(ranks, pattern))
        decimal, plain = _kept("decimal", shared, decimal_table), _kept("bytes", shared, bytes_table)
        for batch in batches:
            for names, ids in _encoded(batch, tokenizer):
                n = pa.array([len(x) for x in ids], pa.int64())
                ids_sha = pa.array([_digest(decimal.parts(x[:-1]), b"%d" % x[-1] if len(x) else b"") for x in ids], pa.string())
                text_sha = pa.array([_digest(plain.parts(x)) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([names, n, ids_sha, text_sha], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
