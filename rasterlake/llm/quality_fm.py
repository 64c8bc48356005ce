"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.words import BLOCK_BYTES, blocks, split_words, text_buffer

#: Hashed words; structure and metadata features follow them.
WORD_BUCKETS = 1 << 16
#: Byte classes whose shares are structure statistics.
_CLASSES = {name: set(chars) for name, chars in {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "line": b"\n", "stop": b".,;:", "loud": b"!?", "mark": b"#*$%&@^~", "bar": b"|<>{}[]\\/_=+`", "quote": b"\"'()-"}.items()}
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_chars)] = _i
_N_CLASSES = len(_CLASSES) + 1
#: Upper ends of the bins of a share, and of a logarithm of base 2.
_SHARES = np.array([1e-9, 0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.22, 0.3, 0.4, 0.55, 0.7, 0.85])
_LOGS = np.arange(0.5, 20, 1.0)
_RATIOS = ("distinct words", "words equal to the last", "repeated lines")
_SIZES = ("words", "lines", "bytes a word", "words a line", "declared characters")
N_FEATURES = WORD_BUCKETS + (_N_CLASSES + len(_RATIOS)) * (len(_SHARES) + 1) + len(_SIZES) * (len(_LOGS) + 2)


def features(texts: pa.Array, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature indexes and values, by row. `declared` is the table's own length of a text, NaN where unknown.

    A text's word values have length 1 together; each statistic sets one indicator to 1/2.
    """
    raw, at = text_buffer(texts)
    n = len(texts)
    hashes, starts, _, offsets = split_words(raw, at)
    words = np.diff(offsets)
    rows = np.repeat(np.arange(n), words)
    keys, counts = np.unique(rows * WORD_BUCKETS + (hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), return_counts=True)
    word_rows = keys // WORD_BUCKETS
    value = 1 + np.log(counts)
    value = value / np.sqrt(np.bincount(word_rows, value * value, n))[word_rows]

    size = np.diff(at)
    if n == 1:  # one text, of any length: by parts, so that nothing is held for each byte
        shares = sum((np.bincount(_CLASS_OF[raw[i : i + BLOCK_BYTES]], minlength=_N_CLASSES) for i in range(0, len(raw), BLOCK_BYTES)), np.zeros(_N_CLASSES, np.int64)).reshape(1, -1)
    else:
        shares = np.bincount(np.repeat(np.arange(n), size) * _N_CLASSES + _CLASS_OF[raw], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    shares = shares / np.maximum(size, 1)[:, None]
    breaks = np.flatnonzero(raw == 10)
    lines = np.bincount(np.searchsorted(at, breaks, side="right") - 1, minlength=n)[:n] + 1
    distinct = np.bincount(word_rows, minlength=n) / np.maximum(words, 1)
    again = np.bincount(rows[1:][(hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])], minlength=n) / np.maximum(words, 1)
    # A line is known by the sum of its words' hashes in order.
    line_keys = np.searchsorted(breaks, starts) + rows
    change = np.flatnonzero(np.concatenate([[True], line_keys[1:] != line_keys[:-1]])) if len(line_keys) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(hashes, change) if len(change) else np.zeros(0, np.uint64)
    line_rows = rows[change] if len(change) else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([line_rows.astype(np.uint64), sums]), axis=1) if len(change) else np.zeros((2, 0), np.uint64)
    filled = np.bincount(line_rows, minlength=n)
    repeated = 1 - np.bincount(pairs[0].astype(np.int64), minlength=n) / np.maximum(filled, 1)

    ratios = np.column_stack([shares, distinct, again, np.where(filled > 0, repeated, 0)])
    first = WORD_BUCKETS
    bins = np.searchsorted(_SHARES, ratios) + first + np.arange(ratios.shape[1]) * (len(_SHARES) + 1)
    first += ratios.shape[1] * (len(_SHARES) + 1)
    sizes = np.column_stack([words, lines, size / np.maximum(words, 1), words / lines, declared])
    logs = np.searchsorted(_LOGS, np.log2(1 + np.nan_to_num(sizes)))
    logs = np.where(np.isnan(sizes), len(_LOGS) + 1, logs) + first + np.arange(len(_SIZES)) * (len(_LOGS) + 2)
    dense = np.concatenate([bins, logs], axis=1)
    all_rows = np.concatenate([word_rows, np.repeat(np.arange(n), dense.shape[1])])
    index = np.concatenate([keys % WORD_BUCKETS, dense.ravel()])
    values = np.concatenate([value, np.full(dense.size, 0.5)])
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], index[order], values[order].astype(np.float32)


@dataclass
class Machine:
    """w0 + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2): linear in the features set."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, rows: np.ndarray, index: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        starts = np.searchsorted(rows, np.arange(n))
        vx = self.v[index] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        square = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[index] * x, starts) + 0.5 * (total * total - square).sum(axis=1)


def train(rows: np.ndarray, index: np.ndarray, x: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 12, least_steps: int = 600, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over minibatches, `epochs` times and at least `least_steps` of them. Without rows: a machine that scores 1/2."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, factors)).astype(np.float32))
    if not len(y):
        return m
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(N_FEATURES, 1e-2, np.float32), np.full((N_FEATURES, factors), 1e-2, np.float32), 1.0
    ends = np.searchsorted(rows, np.arange(len(y) + 1))
    for _ in range(max(epochs, least_steps * 128 // len(y))):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 128):
            take = order[i : i + 128]
            size = ends[take + 1] - ends[take]
            at = np.repeat(ends[take] - np.cumsum(size) + size, size) + np.arange(size.sum())
            r, f, v = np.repeat(np.arange(len(take)), size), index[at], x[at]
            vx = m.v[f] * v[:, None]
            starts = np.cumsum(size) - size
            total = np.add.reduceat(vx, starts, axis=0)
            z = m.bias + np.add.reduceat(m.w[f] * v, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)).astype(np.float32)
            gb += float(g.sum()) ** 2
            m.bias -= rate * float(g.sum()) / gb**0.5
            used, where = np.unique(f, return_inverse=True)
            one = np.bincount(where, g[r] * v, len(used)).astype(np.float32) + decay * m.w[used]
            gw[used] += one * one
            m.w[used] -= rate * one / np.sqrt(gw[used])
            each = (g[r] * v)[:, None] * (total[r] - vx)
            two = np.stack([np.bincount(where, each[:, k], len(used)) for k in range(factors)], axis=1).astype(np.float32) + decay * m.v[used]
            gv[used] += two * two
            m.v[used] -= rate * two / np.sqrt(gv[used])
    return m


def _inputs(docs: DataFrame, id_col: str, text_col: str, declared_col: str | None) -> DataFrame:
    known = F.col(declared_col).cast("double") if declared_col in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), known.alias("declared"))


def held_out(id_: Column) -> Column:
    """One id in five, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", declared_col: str = "n_chars", most: int = 12000) -> Machine:
    """Trains on labelled documents that are not held out.

    `most` bounds the sample (the ids with the smallest hash), so that its features, some 30 MB,
    fit the driver at any corpus size. Null labels are left out; of several labels for an id the
    mean counts, rounded.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(F.col(label_col).cast("double"))).alias("y"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("id"), "id").limit(most))  # at most `most` rows of 16 bytes
    rows = _inputs(docs, id_col, text_col, declared_col).join(marked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                n = len(texts)
                declared = batch.column(2).slice(start, n).to_numpy(zero_copy_only=False).astype(float)
                r, index, x = features(texts, declared)
                ends = np.searchsorted(r, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, n), batch.column(3).slice(start, n), pa.array([index[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                ], names=["id", "y", "index", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, y double, index binary, x binary").toArrow().sort_by("id")
    index = [np.frombuffer(b.as_py(), np.int32) for b in got["index"]]
    x = [np.frombuffer(b.as_py(), np.float32) for b in got["x"]]
    y = got["y"].to_numpy()
    if not len(y):
        return train(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32), y)
    return train(np.repeat(np.arange(len(y)), [len(a) for a in index]), np.concatenate(index), np.concatenate(x), y)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "n_chars") -> DataFrame:
    """The id and `score` in (0, 1) of every whole text; null and empty texts are scored by their statistics. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2.4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                n = len(texts)
                rows, index, x = features(texts, batch.column(2).slice(start, n).to_numpy(zero_copy_only=False).astype(float))
                z = shared.value.margin(rows, index, x, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["id", "score"])

    rows = _inputs(docs, id_col, text_col, declared_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """Trains, then returns id, `held_out`, `score` and `predicted` (1 where the score is at least `threshold`) per input row."""
    machine = fit(docs, labels, **columns)
    id_col = columns.get("id_col", "doc_id")
    scored = score(docs, machine, **{k: v for k, v in columns.items() if k in ("id_col", "text_col", "declared_col")})
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "n_chars") -> DataFrame:
    """The rows of `docs` scored at least `threshold`, with all their columns; texts pass through the scorer and are not shuffled."""
    machine = fit(docs, labels, id_col=id_col, text_col=text_col, declared_col=declared_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = (docs.columns.index(text_col), docs.columns.index(declared_col) if declared_col in docs.columns else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for start, texts in blocks(batch.column(at[0])):
                n = len(texts)
                declared = np.full(n, np.nan) if at[1] is None else batch.column(at[1]).slice(start, n).to_numpy(zero_copy_only=False).astype(float)
                z = shared.value.margin(*features(texts, declared), n)
                keep[start : start + n] = 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
