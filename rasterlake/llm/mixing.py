"""Mixing sources to target weights: Efraimidis-Spirakis sampling after complete epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.llm.scratch import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Classes of a source's keys in an octave. A key is an exponential draw over a weight, so that an
#: octave holds at most some 35 % of the keys of any one weight, and a class at most 0.1 % of a source,
#: whatever its weights. The cut falls in one class of a source; only its rows are sorted exactly.
OCTAVE_CLASSES = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A quality weight from the text alone: its share of characters that are not ASCII digits or marks, at least 0.05."""
    plain = F.length(F.regexp_replace(text.cast("string"), r"[\x21-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(plain, F.length(text.cast("string"))), F.lit(0.05)))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1] from 52 bits of an MD5, the same in every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("double") + 1) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`source, source_size` to the same with `target`.

    Sources by code point, null last, take the weights in turn. All targets add up to `share` of
    all sizes; none is above `most` times its source's size, and what a full source cannot take
    is shared by weight among the rest until none is above. The level at which sources fill up
    is found by one ordered pass: sources sorted by capacity over weight fill up in that order.
    There is one row per source here, not per document.
    """
    order = W.Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = W.Window.partitionBy()
    before = W.Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(W.Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # What a unit of weight gets if all sources before this one are full. It rises as long as sources
    # really are too small for it, and falls after that: the largest is the level of those not full.
    s = s.withColumn("level", F.max((F.col("total") - F.col("full")) / F.col("open")).over(everything))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns per input row the id, `size` in words, `source`, `source_size`, `target`, `weight`,
    `sample_key`, `times` and `taken` = `size * times`. Every document of a source is taken once for each
    complete epoch in the target; the rest of the target goes to the documents with the least
    exponential keys -ln(u)/weight (a sample without replacement, likelier for a larger weight),
    in order of key, id and size, up to the document in whose middle the budget ends. So each
    source comes within one document's half of its target. Only whole documents are taken. Rows
    that are equal in source, id, key, size and text are one document of all their sizes here.

    Null or empty texts have size 0 and are taken with the epochs; a null source is a source of
    its own; a null id has a key too; repeated rows count each. Nothing is sampled by a random
    state: reruns agree. A source of any size is spread over all tasks: keys fall into classes,
    classes are summed, and only the class in which the budget ends is sorted.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.round((weight if weight is not None else letter_share(text)), 6).alias("weight"), uniform(F.col(id_col), seed).alias("u"), F.xxhash64(text.cast("string")).alias("text_hash"),
    )
    rows = rows.withColumn("sample_key", F.round(-F.log("u") / F.col("weight"), 9)).drop("u")
    rows = rows.withColumn("class", F.floor(F.log2(F.greatest("sample_key", F.lit(1e-9))) * OCTAVE_CLASSES).cast("int"))
    rows = stage(rows, "mix")
    classes = rows.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    classes = stage(classes, "mix-classes")
    targets = stage(source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, share, most), "mix-targets")
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    below = W.Window.partitionBy("source").orderBy("class").rowsBetween(W.Window.unboundedPreceding, -1)
    # Some 20,000 rows a source. A class wholly within the budget, or wholly beyond it, is decided here.
    t = targets.withColumnRenamed("source", "s")
    cuts = classes.withColumn("before", F.coalesce(F.sum("class_size").over(below), F.lit(0))).join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cuts = cuts.withColumn("state", F.when(F.col("before") + F.col("class_size") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2))
    c = cuts.select(F.col("source").alias("s"), F.col("class").alias("c"), "before", "rest", "epochs", "source_size", "target", "state")
    rows = rows.join(c, (F.col("class") == F.col("c")) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "c")
    done = rows.where("state <> 2").withColumn("extra", F.col("state"))
    order = ["sample_key", "id", "size", "text_hash"]
    up_to = W.Window.partitionBy("source").orderBy(*order).rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)  # with all equal rows
    equal = F.sum("size").over(W.Window.partitionBy("source", *order))
    cut = rows.where("state = 2").withColumn("middle", F.col("before") + F.sum("size").over(up_to) - equal / 2)
    cut = cut.withColumn("extra", (F.col("middle") <= F.col("rest")).cast("int")).drop("middle")
    out = done.unionByName(cut).withColumn("times", F.col("epochs") + F.col("extra"))
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "weight", "sample_key", "text_hash")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as the mix takes it, with its own columns.

    A row is known by id, source and text, so that rows that share an id are each taken as often
    as the mix says; rows equal in all three are taken alike.
    """
    mixed = mix(docs, id_col, text_col, source_col, **options)
    times = mixed.groupBy(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("text_hash").alias("__text")).agg(F.first("times").alias("__times"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__text"))
    rows = docs.join(times.where("__times > 0"), same)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)
