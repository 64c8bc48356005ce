"""Very long texts in pieces, by DataFrame functions: no row and no array grows with the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Bytes above which a text is worked on in pieces, and characters of a piece on average. Results are the same.
LONG_TEXT, PIECE = 1 << 20, 1 << 19


def is_long(text: Column, limit: int | None = None) -> Column:
    return F.octet_length(text) > (LONG_TEXT if limit is None else limit)


def pieces(rows: DataFrame, keys: list[str], cut: str, size: int | None = None) -> DataFrame:
    """`keys, part, text`: texts cut at the first match of the character class `cut` in each `size` characters, with the match.

    What has no match in it stays whole, so that a piece is longer only where a single word (or
    line) is. Pieces in the order of `part` are the text. `rows` has one row for each value of `keys`.
    """
    size = PIECE if size is None else size
    segments = rows.select(*keys, "text", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int"))).alias("i"))
    segments = segments.select(*keys, "i", F.substring(F.col("text"), F.col("i") * size + 1, F.lit(size)).alias("s"))
    at = F.when(F.col("i") == 0, 1).otherwise(F.regexp_instr("s", F.lit(cut)))
    segments = segments.withColumn("at", at)
    narrow = segments.select(*keys, "i", (F.col("at") > 0).cast("int").alias("begins"))
    part = F.sum("begins").over(W.Window.partitionBy(*keys).orderBy("i").rowsBetween(W.Window.unboundedPreceding, 0))
    numbered = narrow.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("i").alias("__i"), "begins", part.alias("part"))
    same = F.col("i") == F.col("__i")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = segments.join(numbered, same)
    head = F.when(F.col("at") > 0, F.substring(F.col("s"), F.lit(1), F.col("at") - 1)).otherwise(F.col("s"))
    tail = F.when(F.col("at") > 0, F.substring(F.col("s"), F.col("at"), F.lit(size)))
    ends = F.array(F.struct((F.col("part") - F.col("begins")).alias("part"), (F.col("i") * 2).alias("o"), head.alias("s")), F.struct(F.col("part").alias("part"), (F.col("i") * 2 + 1).alias("o"), tail.alias("s")))
    parts = both.select(*keys, F.inline(ends)).where("s is not null and s <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), "")
    return parts.groupBy(*keys, "part").agg(joined.alias("text"))


def with_next(parts: DataFrame, keys: list[str], words: str, n: int) -> DataFrame:
    """Pieces that have `words`, with `before` (words of the text before the piece) and `after` (the next `n` words behind it)."""
    some = parts.where(F.size(words) > 0)
    narrow = some.select(*keys, "part", F.size(words).alias("m"), F.slice(words, 1, n).alias("first"))
    order = W.Window.partitionBy(*keys).orderBy("part")
    before = F.coalesce(F.sum("m").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    after = F.slice(F.flatten(F.collect_list("first").over(order.rowsBetween(1, n))), 1, n)  # a piece has a word at least
    placed = narrow.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("part").alias("__part"), before.alias("before"), after.alias("after"))
    same = F.col("part") == F.col("__part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return some.join(placed, same).drop("__part", *[f"__{k}" for k in keys])
