"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.scratch import drop, new_path, stage

#: Ids from which the middle of a table is estimated.
_SAMPLE = 101


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as an empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A table of digests seen so far, bucketed and sorted by digest, with the id that keeps each text.

    A batch is deduplicated by a sort-merge anti-join: the index side is read by its buckets and
    not shuffled, whatever its size, and the batch has one row a digest. New digests are appended
    with the same buckets. An append that is repeated after a failure adds nothing twice, as
    digests already there no longer pass the anti-join.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None) -> None:
        """The index `table`, which is made if there is none; without a name, one of its own in the shared folder (see `forget`)."""
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = None if table else new_path(spark, "digest-index")

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def _known(self) -> DataFrame:
        return self.spark.table(self.table).hint("merge")

    def add(self, digests: DataFrame) -> DataFrame:
        """Appends what is new of a batch (`id`, `digest`), and returns its groups: `digest`, `first_id`, `group_size`."""
        groups = stage(digests.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        if not self.spark.catalog.tableExists(self.table):
            self._append(groups.select("digest", F.col("first_id").alias("keep_id")).limit(0))
        new = groups.join(self._known(), "digest", "left_anti")
        self._append(new.select("digest", F.col("first_id").alias("keep_id")))
        return groups

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: Sequence[Column] | None = None) -> DataFrame:
        """Deduplicates `docs` and appends its new digests, in batches if conditions on `id` name any.

        Returns one row per input row: the id, `keep_id` (the id that the index keeps: one it held
        before, or the smallest of the first batch that has the text), `group_size` (rows of `docs`
        with the text), `kept` and `text_sha256`. Null texts equal empty ones. A null id is larger
        than any other and keeps a text only if it has no other id; of repeated rows with the id
        to keep, all are marked kept (see `drop_duplicates_of` for a result of single rows).
        """
        rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.encode(normalised(F.col(text_col)), "utf-8"), 256)).alias("digest"))
        rows = stage(rows, "digests")  # 40 bytes a row, so that no text is read or hashed twice
        conditions = batches if batches is not None else [F.lit(True)]
        groups = [self.add(rows.where(condition)) for condition in conditions]
        sizes = groups[0]
        if len(groups) > 1:
            for more in groups[1:]:
                sizes = sizes.unionByName(more)
            sizes = sizes.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
        kept = sizes.select("digest", "group_size").join(self._known(), "digest")
        kept = stage(kept.select("digest", "keep_id", "group_size"), "digest-kept")  # so that the join below meets plain tables, whose skewed partitions Spark splits
        for table in groups:
            drop(table)
        out = rows.join(kept.hint("merge"), "digest")
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def forget(self) -> None:
        """Drops the index and its files."""
        if self.path and self.spark.catalog.tableExists(self.table):
            drop(self.spark.table(self.table))
        self.spark.sql(f"drop table if exists {self.table}")


def halves(docs: DataFrame, id_col: str = "doc_id") -> list[Column]:
    """Conditions on `id` for the smaller and the larger half, nulls in the latter; about half, by a bounded sample."""
    sample = docs.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(_SAMPLE)
    ids = sorted(r["id"] for r in sample.collect())
    if not ids:
        return [F.lit(True)]
    return [F.coalesce(F.col("id") < F.lit(ids[len(ids) // 2]), F.lit(False)), F.coalesce(F.col("id") >= F.lit(ids[len(ids) // 2]), F.lit(True))]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`DigestIndex.deduplicate` with an index of its own, which takes `docs` in two batches, the smaller ids first.

    So the smallest id of each text is kept, and the larger half is deduplicated against what the
    smaller left in the index. The index is dropped when all is read from it.
    """
    index = DigestIndex(docs.sparkSession)
    try:
        return index.deduplicate(docs, id_col, text_col, halves(docs, id_col))
    finally:
        index.forget()


def drop_duplicates_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one for each text.

    Rows that repeat both id and text are one row afterwards. Empty and null texts are one text.
    The key holds id and digest, so that the copies of one text are spread over all tasks.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.concat(name, F.lit(":"), "text_sha256").alias("__key"))
    rows = docs.withColumn("__key", F.concat(name, F.lit(":"), F.sha2(F.encode(normalised(F.col(text_col)), "utf-8"), 256)))
    return rows.join(kept.distinct(), "__key").dropDuplicates(["__key"]).select(*docs.columns)
