"""Jaccard self-join of documents on word n-grams, by rare-first prefix filtering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.llm import key_filter
from rasterlake.llm.components import components
from rasterlake.llm.scratch import drop, stage
from rasterlake.llm.words import blocks, combine, mix, split_words, text_buffer, windows, word_numbers

#: Counters of the document frequencies that order n-grams, as powers of 2: at the least, 4 MB of counts
#: a task and 1 MB as broadcast, and at the most, four times that, which 64 GB of text and more get.
#: Any order gives the same result; more counters tell rare n-grams apart in a larger corpus.
SKETCH_BITS = (20, 22)
_CHUNKS = 64
#: Of the pairs of one pivot that a task compares, were all with that one: pairs and n-grams at most;
#: n-grams that a task compares in all, on average; sets of an n-gram's list in a block.
_PIVOT_PAIRS, _PIVOT_GRAMS, _TASK_GRAMS, _LIST_BLOCK = 8192, 1 << 21, 1 << 21, 512
#: 64-bit words of a set's parity signature.
SIGNATURE = 8
#: Of a block of sets whose links are counted: n-grams and sets at most, on average, and the blocks
#: that a component below these sizes is dealt to; the n-grams of a matrix product.
_BLOCK_GRAMS, _BLOCK_SETS, _SPREAD, _COLUMNS = 1 << 19, 768, 6, 1024


#: The word hash that names of sets are checked with, independent of that of the n-grams.
_SECOND = 0x5851F42D4C957F2D


def _hashed(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's k-word n-grams, and the whole sequence of a text of fewer words: hashes, rows and numbers of words."""
    grams, rows = windows(hashes, offsets, k)
    counts = np.diff(offsets)
    found = [(grams, rows, np.full(len(rows), k))]
    for m in range(1, k):
        r = np.flatnonzero(counts == m)
        h = mix(hashes[offsets[r]] ^ np.uint64(m))
        for i in range(1, m):
            h = combine(h, hashes[offsets[r] + i])
        found.append((h, r, np.full(len(r), m)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _distinct(grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the distinct n-grams of each row, by row and hash."""
    order = np.lexsort((grams, rows))
    g, r = grams[order], rows[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return order[keep]


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text and their rows, sorted by row and hash."""
    hashes, _, _, offsets = split_words(*text_buffer(texts), lower=True)
    grams, rows, _ = _hashed(hashes, offsets, k)
    at = _distinct(grams, rows)
    return grams[at], rows[at]


def _sets_and_checks(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_sets`, and a number of each row's set that comes from its words by another hash."""
    buffer = text_buffer(texts)
    hashes, _, _, offsets = split_words(*buffer, lower=True)
    grams, rows, _ = _hashed(hashes, offsets, k)
    at = _distinct(grams, rows)
    other = mix(_hashed(split_words(*buffer, lower=True, salt=_SECOND)[0], offsets, k)[0][at])
    n = np.bincount(rows[at], minlength=len(texts))
    check = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        with np.errstate(over="ignore"):
            check[some] = np.add.reduceat(other, (np.cumsum(n) - n)[some])
    return grams[at], rows[at], check


def _by_words(grams: np.ndarray, first: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of n-grams (of `size` words from word `first` on), equal for equal words only: hashes that different words share are told apart."""
    _, one, number = np.unique(grams, return_index=True, return_inverse=True)
    like = one[number]
    same = size == size[like]
    for i in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > i)
        same[at] &= (words[first[at] + i] == words[np.minimum(first[like[at]] + i, len(words) - 1)]) | ~same[at]
    if same.all():
        return number
    table = np.full((len(grams), int(size.max()) + 1), -1)
    table[:, 0] = size
    for i in range(table.shape[1] - 1):
        table[size > i, i + 1] = words[first[size > i] + i]
    return np.unique(table, axis=0, return_inverse=True)[1].ravel()


def _sets_by_words(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_sets`, but n-grams are numbers within these texts, equal for equal words only, whatever their hashes."""
    raw, cut = text_buffer(texts)
    hashes, s, e, offsets = split_words(raw, cut, lower=True)
    grams, rows, size = _hashed(hashes, offsets, k)
    n = np.bincount(rows, minlength=len(texts))
    order = np.argsort(rows, kind="stable")
    grams, rows, size = grams[order], rows[order], size[order]
    first = offsets[rows] + np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
    numbers = _by_words(grams, first, size, word_numbers(raw, s, e, lower=True))
    at = _distinct(numbers, rows)
    return numbers[at], rows[at]


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _frequencies(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """The quantised number of documents by n-gram class, over all documents.

    A task sends one array of fixed size, in chunks; they are added up in two levels, so that a
    group has about the square root of the number of tasks.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                total += np.bincount(_bucket(_sets(texts, k)[0], bits), minlength=size)
        if total.any():
            parts = np.split(total, _CHUNKS)
            group = TaskContext.get().partitionId() % 61
            yield pa.RecordBatch.from_arrays([pa.array([group] * _CHUNKS, pa.int32()), pa.array(range(_CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "chunk", "counts"])

    def add(batches: pa.Table) -> pa.Table:
        kind = np.int64 if len(batches["counts"][0].as_py()) == 8 * size // _CHUNKS else np.int32
        total = sum(np.frombuffer(c.as_py(), kind).astype(np.int64) for c in batches["counts"])
        return pa.table({"part": pa.array([0], pa.int32()), "chunk": batches["chunk"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, chunk int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema)
    for keys in (["part", "chunk"], ["chunk"]):
        rows = rows.groupBy(*keys).applyInArrow(add, schema)
    total = np.zeros((_CHUNKS, size // _CHUNKS), np.int64)
    for row in rows.collect():  # 64 rows of a fixed size
        total[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(255, np.log2(total.ravel() + 1.0) * 8).astype(np.uint8)


def _sketch_bits(docs: DataFrame) -> int:
    """One counter more for each factor of 4 in the text, from 4 GB on."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(np.clip(SKETCH_BITS[0] + int(np.log2(max(size, 1) / 2**32)) // 2, *SKETCH_BITS))


def _names(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> pa.Array:
    """A name of each set of so many bits, by its hashed n-grams."""
    digests = b"".join(hashlib.blake2b(grams[a:b].tobytes(), digest_size=8).digest() for a, b in zip(starts, ends, strict=True))
    return pa.array(np.frombuffer(digests, np.int64) >> (64 - bits))


def _told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """Sets with one name but different checks, which come from the words by another hash, get names of both; `clashes` are such names."""
    if clashes is None:
        return rows
    marked = rows.join(F.broadcast(clashes.withColumn("clash", F.lit(True))), "sid", "left")
    return marked.withColumn("sid", F.when(F.col("clash"), F.xxhash64("sid", "more")).otherwise(F.col("sid"))).drop("clash")


def _describe(docs: DataFrame, k: int, percent: int, bits: int, name_bits: int) -> DataFrame:
    """One row per document: id, text_hash, n, sid and more (name of the set), parity signature and prefix n-grams, rarest first."""
    rank = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, k, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                n_rows = len(texts)
                grams, rows, check = _sets_and_checks(texts, k)
                n = np.bincount(rows, minlength=n_rows)
                ends = np.cumsum(n)
                starts = ends - n
                cells = rows * (64 * SIGNATURE) + (grams & np.uint64(64 * SIGNATURE - 1)).astype(np.int64)
                parity = (np.bincount(cells, minlength=n_rows * 64 * SIGNATURE) & 1).astype(np.uint8)
                signature = np.packbits(parity).view(np.int64).reshape(n_rows, SIGNATURE)
                order = np.lexsort((grams, rank.value[_bucket(grams, bits)], rows))
                length = n - (n * percent + 99) // 100 + (n > 0)
                first = (np.arange(len(grams)) - starts[rows]) < length[rows]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(grams[order][first].view(np.int64)))
                columns = [batch.column(0).slice(start, n_rows), batch.column(2).slice(start, n_rows), pa.array(n.astype(np.int32)), _names(grams, starts, ends, name_bits), pa.array(check.view(np.int64)), *[pa.array(signature[:, i]) for i in range(SIGNATURE)], prefix]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n", "sid", "more", *[f"s{i}" for i in range(SIGNATURE)], "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"id {kind}, text_hash long, n int, sid long, more long, {', '.join(f's{i} long' for i in range(SIGNATURE))}, prefix array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` (rep, rep_hash and more columns) with the `text` of the row whose set they name.

    Texts are moved and their sets made again where they are compared, as a text is smaller than
    its set of hashes. Only documents that pass a filter of ids, of a fixed size whatever the number
    of ids, are moved; a wrongly passed one falls out in the join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_filter.collect(wanted.select(key_filter.place("rep").alias("at"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            part = batch.filter(pa.array(key_filter.passes(shared.value, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64))))
            new = []
            for i, key in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                if key not in seen:  # a repeated row repeats its text; once a task is enough
                    seen.add(key)
                    new.append(i)
            if new:
                yield part.select(["id", "text", "text_hash"]).take(pa.array(new, pa.int64()))

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "text", F.xxhash64("text").alias("text_hash"), key_filter.place("id").alias("at")).mapInArrow(run, f"id {kind}, text string, text_hash long")
    return rows.join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).drop("id", "rep", "text_hash", "rep_hash")


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """`sid, n, rep, copies, pos, token` of the prefix n-grams that may be in two sets.

    Most are in one only. They are counted by the low 32 bits of their hash, which moves little, and those
    that are found twice make a bitmap sized by their number, which the tasks that read the
    prefixes test; the few n-grams that pass by chance are left out by the count of whole n-grams.
    """
    keys = classes.select(F.explode("prefix").alias("token")).groupBy(F.shiftright(F.shiftleft("token", 32), 32).cast("int").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = stage(keys.select("key"), "keys")
    bits = key_filter.bits_for(keys.count())
    shared = classes.sparkSession.sparkContext.broadcast(key_filter.collect(keys.select(F.shiftrightunsigned("key", 32 - bits).alias("at")), bits))
    drop(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                prefix = part.column(4)
                n = prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                token = prefix.flatten().to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(key_filter.passes(shared.value, (token & 0xFFFFFFFF) >> (32 - bits)))
                row = np.repeat(np.arange(len(n)), n)[keep]
                pos = (keep - (np.cumsum(n) - n)[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(row)) for c in range(4)], pa.array(pos), pa.array(token[keep])], names=["sid", "n", "rep", "copies", "pos", "token"])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("sid", "n", "rep", "copies", "prefix").mapInArrow(run, f"sid long, n int, rep {kind}, copies long, pos int, token long")


def _length(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _positional(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """The n-grams from this common one on can still make up the overlap, as at the first common n-gram of a linked pair."""
    return (F.least(na - pa_, nb - pb)) * (100 + percent) >= (na + nb) * percent


def _differ(a: str, b: str) -> Column:
    """Classes of n-grams that two sets hold with different parity."""
    return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SIGNATURE)), F.lit(0))


def _suffix(a: str, b: str, na: Column, nb: Column, percent: int) -> Column:
    """Hamming bound: in each class that differs in parity, at least one n-gram is in one set only."""
    return _differ(a, b) * (100 + percent) <= (na + nb) * (100 - percent)


def _fetch(docs: DataFrame, pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The texts of `pairs` (a, b, n) by the comparison they are for: `b, block, pivot, main, sid, part, text`.

    A text `a` goes to a block of its pivot `b`, and the pivot's text once to each of its blocks, so
    that no task meets more than a share of one pivot's pairs, of any number and length of texts.
    Of the rows of one set, one is `main`. Blocks of like size are dealt to `part`s.
    """
    count, grams = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()  # one row
    spread = max(16, -(-count // _PIVOT_PAIRS), -(-grams // _PIVOT_GRAMS))
    parts = max(1, -(-2 * grams // _TASK_GRAMS))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(spread)).cast("int"))
    members = pairs.select(F.col("a").alias("sid"), "b", "block", F.lit(False).alias("pivot"))
    pivots = pairs.select(F.col("b").alias("sid"), "b", "block", F.lit(True).alias("pivot")).distinct()
    order = W.Window.partitionBy("sid").orderBy("pivot", "b", "block")
    wanted = members.unionByName(pivots).withColumn("main", F.row_number().over(order) == 1).withColumn("part", F.pmod(F.xxhash64("b", "block"), F.lit(parts)).cast("int"))
    wanted = stage(wanted.join(info.select("sid", "rep", "rep_hash"), "sid"), "wanted")
    return stage(_texts_of(docs, wanted), "texts")


def _verify(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the threshold, each compared once."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("b", "ascending"), ("block", "ascending"), ("pivot", "descending")])
        b, block, sid, pivot = (table[c].to_numpy(zero_copy_only=False) for c in ("b", "block", "sid", "pivot"))
        starts = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (block[1:] != block[:-1])]))
        found = []
        texts_ = table["text"].combine_chunks()
        for start, end in zip(starts, np.append(starts[1:], len(b)), strict=True):
            if not pivot[start]:
                continue
            pivot_text = texts_.slice(start, 1)
            at = start + int(pivot[start:end].sum())  # a repeated row repeats its pivot
            for first, some in blocks(texts_.slice(at, end - at)):
                grams, rows = _sets_by_words(pa.concat_arrays([pivot_text, some]), k)
                size = int(np.searchsorted(rows, 1))
                one, grams, rows = grams[:size], grams[size:], rows[size:] - 1
                n = np.bincount(rows, minlength=len(some))
                place = np.minimum(np.searchsorted(one, grams), len(one) - 1)
                common = np.bincount(rows[one[place] == grams], minlength=len(some))
                hit = np.flatnonzero(common * 100 >= (n + len(one) - common) * percent)
                found.append((sid[at + first + hit], np.full(len(hit), b[start])))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(np.concatenate([y for _, y in found]) if found else a, pa.int64())})

    rows = texts.select("b", "block", "pivot", "sid", "part", "text")
    return rows.groupBy("part").applyInArrow(compare, "a long, b long").distinct()  # a repeated row repeats its set


def _list_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n of a) of sets that share an n-gram, are in different components and pass the filters.

    A long list of sets is dealt to blocks, and each two of its blocks are one group of the join,
    so that a list of any length is spread over many tasks and no pair of it is left out.
    """
    sizes = placed.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    rows = placed.join(sizes.select("token", F.ceil(F.col("df") / _LIST_BLOCK).cast("int").alias("blocks")), "token")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "i", "j")]
    once = (F.col("x.i") == F.col("x.j")) | (F.col("x.own") != F.col("y.own"))
    found = (F.col("x.sid") < F.col("y.sid")) & (F.col("x.c") != F.col("y.c")) & once & _length(F.col("x.n"), F.col("y.n"), percent) & _positional(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    found = found & _suffix("x", "y", F.col("x.n"), F.col("y.n"), percent)
    return x.join(y, same[0] & same[1] & same[2] & found).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.n").alias("n"))


def _common(rows: np.ndarray, grams: np.ndarray, m: int) -> np.ndarray:
    """The n-grams that each two of `m` sets share, from the n-grams of each row."""
    _, column, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts > 1
    rows, column = rows[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((m, m))
    for start in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        part = np.zeros((m, _COLUMNS), np.float32)
        part[rows[a:b], column[a:b] - start] = 1
        total += part @ part.T
    return total


def _count_links(texts: DataFrame, comps: DataFrame, info: DataFrame, k: int, percent: int) -> DataFrame:
    """`sid, n_links`: the sets of the same component that each set meets the threshold with, all compared.

    Linked sets are in one component, so no other pairs are needed; in a component of two sets the
    link is known. The sets of a larger one go to blocks by their hash, of about `_BLOCK_GRAMS`
    n-grams or `_BLOCK_SETS` sets at most, and a task compares two blocks by matrix products and
    returns counts, never pairs: rows grow with the members times the blocks.
    """
    placed = comps.withColumnRenamed("v", "sid").join(info.select("sid", "n"), "sid")
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    spread = F.least(F.lit(_SPREAD), F.ceil(F.col("m") / 64))  # a middling component goes to several tasks too
    sizes = sizes.withColumn("blocks", F.greatest(spread, F.ceil(F.col("w") / _BLOCK_GRAMS), F.ceil(F.col("m") / _BLOCK_SETS)).cast("int"))
    placed = stage(placed.join(sizes, "c").select("sid", "c", "m", "blocks"), "members")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    rows = texts.join(placed.where("m > 2"), "sid").select("c", "sid", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "text")

    def count(table: pa.Table) -> pa.Table:
        sid, first = np.unique(table["sid"].to_numpy(), return_index=True)  # a repeated row repeats its set
        texts_ = table["text"].combine_chunks().take(pa.array(first))
        grams, row = _sets_by_words(texts_, k)
        n = np.bincount(row, minlength=len(sid))
        common = _common(row, grams, len(sid))
        linked = common * 100 >= (n[:, None] + n[None, :] - common) * percent
        np.fill_diagonal(linked, False)
        block = table["own"].to_numpy()[first]
        if table["i"][0].as_py() != table["j"][0].as_py():  # pairs within a block are counted where it meets itself
            linked &= block[:, None] != block[None, :]
        return pa.table({"sid": pa.array(sid, pa.int64()), "n_links": pa.array(linked.sum(axis=1), pa.int64())})

    counts = rows.groupBy("c", "i", "j").applyInArrow(count, "sid long, n_links long").groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    return counts.unionByName(placed.where("m = 2").select("sid", F.lit(1).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int | None = None, count_links: bool = True, name_bits: int = 64) -> DataFrame:
    """Groups of documents whose sets of k-word n-grams have a Jaccard similarity of percent/100 or more.

    Returns per input row the id, `n_shingles`, `set_id` (documents with the same set share it),
    `n_links` (all links to other sets), `component_id` (the smallest id that links reach) and
    `text_hash`; without `count_links` no `n_links`. Links are verified and counted on the words
    themselves. A set's name has `name_bits` bits of a digest of its n-grams' hashes, and sets that
    meet in a name are told apart by 64 bits of another hash of their words.
    Lower-cased ASCII, whole texts. A text of fewer than k words is one n-gram; a text without
    words, or null, has none and is linked with nothing. Repeated rows share a set. A null id
    takes part, but is never a component's id unless the group has no other.

    Documents with equal sets are one class from the start. The rest is a prefix-filter join: two
    sets that reach the threshold share one of their rarest n-grams (the order comes from the
    document frequencies of all documents), and pass the length, positional and suffix filters.
    Components need no more links than connect them, so that the join goes in two steps. First
    each n-gram's sets are compared with two of them only. Then the sets that share an n-gram
    but are in different components are compared, all of them, which finds every link that is
    still missing between components. So a large group of near copies gives about as many pairs as it has
    members, and the components are those of the full join. Last, the links within each
    component are counted, between all its sets (`_count_links`).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    described = stage(_describe(docs, k, percent, _sketch_bits(docs) if sketch_bits is None else sketch_bits, name_bits), "described")
    signature = [f"s{i}" for i in range(SIGNATURE)]
    firsts = [F.first(c).alias(c) for c in ("n", *signature, "prefix")]

    def in_classes(rows: DataFrame) -> DataFrame:
        grouped = rows.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("more").alias("more"), F.max("more").alias("most"), *firsts)
        return stage(grouped.select("*", F.col("first.id").alias("rep"), F.col("first.text_hash").alias("rep_hash")).drop("first"), "classes")

    classes, clashes = in_classes(described), None
    if classes.where("more <> most").limit(1).count():
        clashes = stage(classes.where("more <> most").select("sid"), "clashes")
        classes = in_classes(_told_apart(described, clashes))
    sets = stage(_told_apart(described.select("id", "text_hash", "n", "sid", "more"), clashes).drop("more"), "names")
    drop(described)
    info = stage(classes.drop("prefix", "more", "most"), "info")

    # Step 1: the set with most copies and the oldest one, likely central, stand for an n-gram's list.
    tokens = _shared_tokens(classes)
    pivot = [F.min(F.struct(*x, "sid", "n", "pos")).alias(f"p{i}") for i, x in enumerate(((-F.col("copies"), F.col("rep")), (F.col("rep"),)))]
    lists = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *pivot).where("df > 1")
    lists = lists.select("token", "df", *[F.struct(F.col(f"p{i}.sid").alias("b"), F.col(f"p{i}.n").alias("nb"), F.col(f"p{i}.pos").alias("pb")).alias(f"p{i}") for i in range(2)])
    shared = stage(tokens.select("sid", "n", "pos", "token").join(lists, "token"), "tokens")
    drop(classes)
    near = shared.withColumn("p", F.explode(F.array_distinct(F.array("p0", "p1")))).select("sid", "n", "pos", "p.*")
    near = near.where((F.col("sid") != F.col("b")) & _length(F.col("n"), F.col("nb"), percent) & _positional(F.col("n"), F.col("pos"), F.col("nb"), F.col("pb"), percent))
    near = near.select("sid", "b").distinct().join(info.alias("x"), "sid").join(info.alias("y"), F.col("b") == F.col("y.sid"))
    near = near.where(_suffix("x", "y", F.col("x.n"), F.col("y.n"), percent))
    likely = stage(near.select(F.col("x.sid").alias("a"), "b", F.col("x.n").alias("n"), _differ("x", "y").alias("differ")), "likely")
    # Each set is verified with the likeliest of its pivots only; step 2 finds what that leaves apart.
    near = likely.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"), F.max("n").alias("n"))
    near = near.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("a", "b", "n")).alias("pair"))  # one of two that choose each other
    near = stage(near.select("pair.*", "lo", "hi"), "pairs")
    whole = _fetch(docs, near.select("a", "b", "n"), info)
    links = stage(_verify(whole, k, percent), "links")
    comps = stage(components(links), "components")

    # Step 2: what is left between different components, in full. A list of two has been compared above.
    placed = shared.where("df > 2").select("sid", "n", "pos", "token").join(comps.withColumnRenamed("v", "sid"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    placed = stage(placed.join(mixed, "token").join(info.select("sid", *signature), "sid"), "placed")
    drop(shared)
    apart = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")
    for end in ("a", "b"):
        apart = apart.join(comps.select(F.col("v").alias(end), F.col("c").alias(f"c{end}")), end, "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "n")
    left = _list_pairs(placed, percent).unionByName(apart).groupBy("a", "b").agg(F.max("n").alias("n")).join(near.select(F.col("lo").alias("a"), F.col("hi").alias("b")), ["a", "b"], "left_anti")
    left = stage(left, "pairs")
    drop(placed)
    drop(likely)
    if left.limit(1).count():
        later = _fetch(docs, left, info)
        links = stage(links.unionByName(_verify(later, k, percent)), "links")
        comps = stage(components(links), "components")
        main = later.where("main").join(whole.select("sid"), "sid", "left_anti")
        texts = whole.where("main").select("sid", "text").unionByName(main.select("sid", "text"))
    else:
        later, texts = None, whole.where("main").select("sid", "text")

    named = info.select("sid", "rep").join(comps.withColumnRenamed("v", "sid"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "c")
    if count_links:
        named = named.join(stage(_count_links(texts, comps, info, k, percent), "counts"), "sid", "left")
    for table in (whole, later):
        if table is not None:
            drop(table)
    out = sets.join(named.drop("c", "rep"), "sid", "left")
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("set_id"), *counted, component, "text_hash")


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that name their group, with all their columns; rows with a null id stay.

    Of rows that share an id but not the text, only those go whose own text is in another's group.
    """
    groups = near_duplicates(docs, k, percent, id_col, text_col, count_links=False)
    gone = groups.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash")), "left_anti")
