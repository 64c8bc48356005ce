"""Importance resampling towards a target distribution: hashed n-gram gains, Gumbel noise, the best-scored share drawn."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.scratch import stage
from rasterlake.llm.tokens import OCCURRENCES, Interned, joined, lower_words, ngrams
from rasterlake.llm.words import blocks, text_buffer
from rasterlake.operators.manifest import dense_index
from rasterlake.operators.selection import kth_smallest


def _interned(texts: pa.Array, lo: int, hi: int, buckets: int) -> Iterator[tuple[Interned, np.ndarray, np.ndarray]]:
    """Interned n-grams of the texts, some at a time, with the row of each occurrence; and the words of each text, with the first."""
    raw, s, e, offsets = lower_words(*text_buffer(texts))
    words = np.diff(offsets)
    raw, s, e = joined(raw, s, e)
    s, e, rows = ngrams(s, e, offsets, lo, hi)
    for i in range(0, max(len(s), 1), OCCURRENCES):
        part = slice(i, i + OCCURRENCES)
        yield Interned(raw, s[part], e[part], buckets), rows[part], words if i == 0 else np.zeros_like(words)


def bucket_counts(texts: DataFrame, text_col: str = "text", lo: int = 1, hi: int = 1, buckets: int = 10_000) -> DataFrame:
    """`bucket, n`: occurrences of all n-grams of all texts by bucket, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in blocks(batch.column(0)):
                for table, _, _ in _interned(some, lo, hi, buckets):
                    np.add.at(total, table.bucket[table.used], table.count[table.used])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(target: DataFrame, corpus: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) by bucket, from two `bucket_counts` of at most `buckets` rows each."""
    counts = []
    for df in (target, corpus):
        one = np.zeros(buckets, np.int64)
        for row in df.collect():  # at most `buckets` rows
            one[row["bucket"]] = row["n"]
        counts.append(one)
    (t, s), (big_t, big_s) = counts, (int(x.sum()) for x in counts)
    return np.array([math.floor(1000 * math.log((a + 1.0) * (big_s + float(buckets)) / ((b + 1.0) * (big_t + float(buckets))))) for a, b in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", lo: int = 1, hi: int = 1) -> DataFrame:
    """Per input row the id, `n_words`, `n_features` and `weight`, the sum of the gains of all n-grams of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in blocks(batch.column(1)):
                words, features, weight = (np.zeros(len(some), np.int64) for _ in range(3))
                for table, rows, n in _interned(some, lo, hi, len(gains)):
                    words += n
                    features += np.bincount(rows, minlength=len(some))
                    np.add.at(weight, rows, shared.value[table.bucket[table.slot]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), pa.array(words), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256(`seed:key`); the same in every run. A null key is an empty one."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", lo: int = 1, hi: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Per input row the id, `n_words`, `n_features`, `weight`, `score` and `rank` (1 up for the drawn, null for others).

    Words are lower-cased ASCII (see `tokens`), features all runs of `lo` to `hi` words, counted by
    the CRC-32 of their bytes modulo `buckets`. A bucket's gain compares its share of the target with
    its share of the corpus; a document's score is the sum of the gains of its features and Gumbel
    noise of its id, and of the documents with at least `least_words` words the best `percent` in a
    hundred are drawn, rounded down, which draws without replacement in proportion to exp(weight / 1000).

    A null or empty text has no features and weight 0. Ties in the score go to the smaller id, null
    ids last; repeated rows are drawn each for itself. An empty corpus gives no rows, an empty target
    counts as one without features. Other columns play no part.

    N-grams are interned a batch at a time in an open-addressed table (`tokens.Interned`). The last
    score drawn is found by counting bits of scores, and only the drawn rows are ordered, in sampled
    ranges: no task sorts the table.
    """
    corpus = bucket_counts(docs, text_col, lo, hi, buckets)
    gains = bucket_gains(bucket_counts(target, target_col, lo, hi, buckets), corpus, buckets)
    rows = weigh(docs, gains, id_col, text_col, lo, hi)
    rows = stage(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    columns = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    found = kth_smallest(able.select((-F.col("score")).alias("key")), "key", k)
    if found is None:  # nothing to draw
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = -found[0]
    good = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    drawn = dense_index(rows.where(good), [F.desc("score"), F.asc_nulls_last("id")], name="rank")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") < k, F.col("rank") + 1).cast("long"))
    return drawn.select(*columns, "rank").unionByName(rows.where(~good).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents whose id is drawn, with all their columns."""
    ids = resample(docs, target, id_col=id_col, **options).where("rank is not null").select(F.col(id_col).alias("__id")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
