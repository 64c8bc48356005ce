"""Substring dedup: repeated word passages, by an FM-index per shard over the places that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm import key_filter
from rasterlake.llm.fm_index import FMIndex
from rasterlake.llm.scratch import drop, stage
from rasterlake.llm.words import blocks, combine, slices, spaced, split_words, text_buffer, windows

#: Words of an anchor; a window's anchor is its least-hashed run of so many words.
ANCHOR = 10
#: Segments (of up to 2 * length - ANCHOR words) in an index: some 400,000 words.
SHARD_SEGMENTS = 6000
#: An anchor with more different segments than this is split by the windows themselves.
HOT_SEGMENTS = 10_000
#: Segments that a task remembers having sent the words of; to forget them costs only sending some twice.
SENT = 1_000_000


def _anchors(hashes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor hash, and first and last start (from the document's first word) of the windows that each anchor stands for.

    The anchor of a window depends on its words alone, so that equal windows have equal anchors.
    """
    empty = np.zeros(0, np.int64)
    width = length - ANCHOR + 1  # runs in a window
    n = len(hashes) - length + 1
    if n <= 0:
        return empty, np.zeros(0, np.uint64), empty, empty
    runs = hashes[: len(hashes) - ANCHOR + 1]
    for i in range(1, ANCHOR):
        runs = combine(runs, hashes[i : len(hashes) - ANCHOR + 1 + i])
    best, span = np.arange(len(runs)), 1
    while span < width:  # the leftmost least run of 1, 2, 4, ... runs, and at last of `width`
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(runs[a] <= runs[b], a, b)
        span += step
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(rows[:n] == rows[length - 1 :])
    at = best[inside]
    if not len(at):
        return empty, np.zeros(0, np.uint64), empty, empty
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (rows[inside[1:]] != rows[inside[:-1]])]))
    last = inside[np.append(new[1:], len(at)) - 1]
    first = inside[new]
    row = rows[first]
    return row, runs[at[new]], first - offsets[row], last - offsets[row]


def _text_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each row's words in order, to tell rows of one id apart."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n, np.uint64)
    each = combine(hashes, (np.arange(len(hashes)) - offsets[rows]).astype(np.uint64))
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = np.add.reduceat(each, offsets[some])
    return out.view(np.int64)


#: SHA-256 of no words.
_NOTHING = hashlib.sha256(b"").digest()


def _base(docs: DataFrame, kind: str, length: int) -> DataFrame:
    """Per row: id, text_key, n_words, the digest of all words, and anchor hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                n = len(texts)
                raw, at = text_buffer(texts)
                hashes, s, e, offsets = split_words(raw, at)
                row, anchor, _, _ = _anchors(hashes, offsets, length)
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                data, place = spaced(raw, s, e)
                view = memoryview(data)
                digests = [hashlib.sha256(view[place[a] : place[b] - 1]).digest() if a < b else _NOTHING for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(anchor.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(_text_keys(hashes, offsets)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(digests, pa.binary()), lists], names=["id", "text_key", "n_words", "all_sha256", "anchors"])

    return docs.mapInArrow(run, f"id {kind}, text_key long, n_words long, all_sha256 binary, anchors array<long>")


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes from each start to each end, two numbers of 64 bits of one cryptographic digest."""
    view = memoryview(np.ascontiguousarray(data))
    both = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    both = np.frombuffer(both, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _segments(docs: DataFrame, kind: str, once: DataFrame, repeated: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The words around each anchor that more than one document has: places, and words.

    Places have `id, text_key, anchor, first, digest` (of the words), a row for each; words
    have `anchor, digest, words` (with one space between), once a task for each different segment.
    Both are made from the texts when they are read. Ids that keep a text, and then the anchors made
    again from the texts, pass bitmaps of fixed size, so that no text is moved. Segments of one anchor
    and digest are compared: in a task by 64 bits more, in their shard by the words. Should any differ,
    the job ends with an error.
    """
    bits = key_filter.BITS
    first = docs.sparkSession.sparkContext.broadcast(key_filter.collect(once.select(key_filter.place("id").alias("at"))))
    shared = docs.sparkSession.sparkContext.broadcast(key_filter.collect(repeated.select(F.shiftrightunsigned("anchor", 64 - bits).cast("int").alias("at"))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            batch = batch.filter(pa.array(key_filter.passes(first.value, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))))
            for start, texts in blocks(batch.column(1)):
                raw, at = text_buffer(texts)
                hashes, s, e, offsets = split_words(raw, at)
                row, anchor, start_at, last = _anchors(hashes, offsets, length)
                keep = key_filter.passes(shared.value, (anchor >> np.uint64(64 - bits)).astype(np.int64))
                row, anchor, start_at, last = row[keep], anchor[keep], start_at[keep], last[keep]
                data, place = spaced(raw, s, e)
                yield batch.column(0).slice(start, len(texts)), hashes, offsets, data, place, row, anchor, start_at, last + length

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, offsets, data, place, row, anchor, first_, end in found(batches):
            digest, _ = _digests(data, place[offsets[row] + first_], place[offsets[row] + end] - 1)
            columns = [ids.take(pa.array(row)), pa.array(_text_keys(hashes, offsets)[row]), pa.array(anchor.view(np.int64)), pa.array(first_.astype(np.int32)), pa.array(digest)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "anchor", "first", "digest"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for _, _, offsets, data, place, row, anchor, first_, end in found(batches):
            starts, ends = place[offsets[row] + first_], place[offsets[row] + end] - 1
            digest, more = _digests(data, starts, ends)
            new = []
            for i, (key, check) in enumerate(zip(zip(anchor.tolist(), digest.tolist(), strict=True), more.tolist(), strict=True)):
                if key not in sent:
                    sent[key] = check
                    new.append(i)
                elif sent[key] != check:
                    raise RuntimeError("one digest of different words")
            if len(sent) > SENT:
                sent.clear()
            for i in range(0, len(new), 20_000):  # a long text has many
                n = np.array(new[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[n].view(np.int64)), pa.array(digest[n]), slices(data, starts[n], ends[n])], names=["anchor", "digest", "words"])

    return docs.mapInArrow(places, f"id {kind}, text_key long, anchor long, first int, digest long"), docs.mapInArrow(words, "anchor long, digest long, words binary")


def _split(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Each window of a segment as a segment of its own, whose anchor is its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raw, at = text_buffer(part.column(4))
                hashes, s, e, offsets = split_words(raw, at)
                anchor, row = windows(hashes, offsets, length)
                data, place = spaced(raw, s, e)
                n = np.bincount(row, minlength=part.num_rows)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                from_ = offsets[row] + inside
                first = part.column(3).to_numpy()[row] + inside
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(anchor.view(np.int64)), pa.array(first.astype(np.int32)), slices(data, place[from_], place[from_ + length] - 1)], names=batch.schema.names)

    return rows.mapInArrow(run, f"id {kind}, text_key long, anchor long, first int, words binary")


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _earlier(words: DataFrame, least: DataFrame, kind: str, shards: int, length: int) -> DataFrame:
    """For each different segment its windows, and the runs of those that a smaller id than its own least one has.

    One FM-index a shard, over the shard's own dictionary of words; the shard's segments are
    streamed through it. A window's interval in the suffix array holds all segments that have it,
    and the document array tells the smallest id of them.
    """

    def in_order(table: pa.Table) -> pa.Table:
        """Rows by anchor and digest, one of each; those of one digest are compared by their words."""
        table = table.combine_chunks().sort_by([("anchor", "ascending"), ("digest", "ascending")])
        same = pc.and_(*[pc.equal(table[c][1:], table[c][:-1]) for c in ("anchor", "digest")]) if table.num_rows > 1 else pa.array([], pa.bool_())
        if "words" in table.column_names and pc.any(pc.and_(same, pc.not_equal(table["words"][1:], table["words"][:-1]))).as_py():
            raise RuntimeError("one digest of different words")
        first = np.ones(table.num_rows, bool)
        first[1:] = ~same.to_numpy(zero_copy_only=False) if isinstance(same, pa.Array) else ~same.to_numpy()
        return table.filter(pa.array(first))

    def search(texts: pa.Table, table: pa.Table) -> pa.Table:
        table, texts = in_order(table), in_order(texts)
        if not (texts["anchor"].equals(table["anchor"]) and texts["digest"].equals(table["digest"])):
            raise RuntimeError("places and words of segments differ")  # both are made from the same texts
        lists = pc.split_pattern(texts["words"].combine_chunks(), " ")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        flat = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, own = np.unique(np.array(table["least"].to_pylist()), return_inverse=True)
        found = FMIndex(flat, ends, own, length).earliest(flat, ends)
        n = sizes - length + 1
        flags = (found < np.repeat(own, n)).astype(np.int8)
        at = np.cumsum(n)
        runs = [_runs(flags[b - k : b]) if flags[b - k : b].any() else [] for b, k in zip(at, n, strict=True)]
        type_ = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.table({"anchor": table["anchor"], "digest": table["digest"], "least": table["least"], "n": pa.array(n.astype(np.int32)), "runs": pa.array(runs, type_)})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    one, other = words.select(shard, "anchor", "digest", "words"), least.select(shard, "anchor", "digest", "least")
    return one.groupBy("shard").cogroup(other.groupBy("shard")).applyInArrow(search, f"anchor long, digest long, least {kind}, n int, runs array<struct<a: int, b: int>>")


def _texts_once(base: DataFrame) -> DataFrame:
    """The smallest id of each text; rows with a null id have no part in it."""
    return base.where(F.col("id").isNotNull()).groupBy("all_sha256").agg(F.min("id").alias("first_id"))


def repeated_windows(docs: DataFrame, base: DataFrame, length: int = 50) -> DataFrame:
    """The windows that also start in a document with a smaller id, as runs [a, b) of starts: id, text_key, runs.

    Of equal texts only the one with the smallest id is surely searched; the others are wholly repeated.

    1. Winnowing: each window has an anchor, about one anchor in 20 words. Only anchors that two
       ids share can lie in a repeated window; all are counted, over all documents.
    2. The words that such anchors stand for go to the anchor's shard, each different segment
       once a task, and the smallest id that has it. Anchors with very many different segments are
       split by window, so that a shard stays of bounded size whatever repeats.
    3. Each shard builds a compressed FM-index over the words themselves and streams its segments
       through backward search; the interval of a window tells the smallest id that has it.
    """
    kind = docs.schema["id"].dataType.simpleString()
    once = base.join(_texts_once(base), "all_sha256").where("id = first_id")
    once = stage(once.select("id", "anchors"), "once")
    anchors = once.select("id", F.explode("anchors").alias("anchor"))
    repeated = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    repeated = stage(repeated, "anchors")
    texts = docs.where(F.col("id").isNotNull()).select("id", "text", key_filter.place("id").alias("at"))
    places, words = _segments(texts, kind, once, repeated, length)
    drop(once)
    drop(repeated)
    places = stage(places, "places")
    least = stage(places.groupBy("anchor", "digest").agg(F.min("id").alias("least")), "least")
    hot = stage(least.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SEGMENTS).select("anchor"), "hot")
    used = [places, least]
    if hot.limit(1).count():
        words = stage(words, "words")
        few = places.join(hot, "anchor").join(words.join(hot, "anchor").dropDuplicates(["anchor", "digest"]), ["anchor", "digest"])
        split = _split(few.select("id", "text_key", "anchor", "first", "words"), kind, length).withColumn("digest", F.xxhash64("words"))
        split = stage(split, "split")
        windows_ = stage(split.groupBy("anchor", "digest").agg(F.first("words").alias("words"), F.min("id").alias("least")), "windows")
        used += [words, split, windows_]
        places = places.join(hot, "anchor", "left_anti").unionByName(split.drop("words"))
        words = words.join(hot, "anchor", "left_anti").unionByName(windows_.drop("least"))
        least = least.join(hot, "anchor", "left_anti").unionByName(windows_.drop("words"))
    shards = max(1, -(-least.count() // SHARD_SEGMENTS))
    earlier = stage(_earlier(words, least, kind, shards, length), "earlier")
    found = places.join(earlier, ["anchor", "digest"])
    # A later holder of the segment has all its windows after the first holder; the first has those found in smaller ids.
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    runs = F.when(F.col("id") > F.col("least"), whole).otherwise(F.col("runs"))
    found = found.select("id", "text_key", F.transform(runs, lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))).alias("runs"))
    found = stage(found.where(F.size("runs") > 0).groupBy("id", "text_key").agg(F.flatten(F.collect_list("runs")).alias("runs")), "cuts")
    for table in (*used, earlier):
        drop(table)
    return found


def _without(words: np.ndarray, place: np.ndarray, runs: np.ndarray, length: int) -> tuple[int, bytes]:
    """How many words windows at the runs' starts cover, and the digest of the other words; `words` and `place` are of `spaced`."""
    change = np.zeros(len(place), np.int64)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, runs[:, 1] - 1 + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = words[np.repeat(kept, np.diff(place))].tobytes()
    return int(len(kept) - kept.sum()), hashlib.sha256(memoryview(left)[: len(left) - 1] if left else b"").digest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Per input row: the id, `n_words`, `n_removed` and `kept_sha256` (the kept words joined by one space).

    A word goes if a window of `length` words over it also starts in a document with a smaller
    id, of whatever type ids are. Null and empty texts have no words. Rows that repeat an id are
    one document, so none removes from another; rows with a null id neither lose words nor make
    others lose any. Segments of text that meet in a digest are compared, and windows are told apart by the words themselves.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    base = stage(_base(docs, kind, length), "passages")
    cuts = repeated_windows(docs, base, length)
    rows = stage(base.drop("anchors").join(_texts_once(base), "all_sha256", "left"), "rows")
    drop(base)
    shared = docs.sparkSession.sparkContext.broadcast(key_filter.collect(cuts.select(key_filter.place("id").alias("at"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(key_filter.passes(shared.value, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))))
            for start, texts in blocks(part.column(1)):
                hashes, _, _, offsets = split_words(*text_buffer(texts))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(start, len(texts)), pa.array(_text_keys(hashes, offsets)), texts], names=["id", "text_key", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(2)):
                raw, at = text_buffer(texts)
                _, s, e, offsets = split_words(raw, at)
                data, place = spaced(raw, s, e)
                out = []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    runs = np.array([(r["a"], r["b"]) for r in batch.column(3)[start + i].as_py()], np.int64)
                    out.append(_without(data[place[a] : place[b]], place[a : b + 1] - place[a], runs, length))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array([n for n, _ in out], pa.int64()), pa.array([h for _, h in out], pa.binary())], names=["id", "text_key", "n_removed", "sha"])

    texts = docs.where(F.col("id").isNotNull()).select("id", "text", key_filter.place("id").alias("at")).mapInArrow(pick, f"id {kind}, text_key long, text string")
    changed = texts.join(cuts, ["id", "text_key"]).mapInArrow(cut, f"id {kind}, text_key long, n_removed long, sha binary").dropDuplicates(["id", "text_key"])
    out = rows.join(changed, ["id", "text_key"], "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= length)
    gone = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("sha", "all_sha256"))
    return out.select(F.col("id").alias(id_col), "n_words", gone.alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256"))
