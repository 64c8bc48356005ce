"""Quality rules of documents and of their hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.pieces import is_long, pieces, with_next
from rasterlake.llm.scratch import stage

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are sorted with their positions, so that equal ones are neighbours; the positions of
    those that have an equal neighbour are sorted again, and each adds the words up to the next.
    The cost is that of two sorts, however often a window repeats.
    """
    two = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = F.slice(F.zip_with(two, F.slice(words, 3, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), 1, n - 2)
    return F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))


def _covered(places: Column) -> Column:
    after = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.lit(1 << 30)))
    return F.when(F.size(places) > 0, F.aggregate(F.zip_with(places, after, lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda x, y: x + y))


def _word_chars(text: str) -> Column:
    return F.length(F.regexp_replace(text, SPACES, "")).cast("long")


def _symbols(text: str) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", long_text: int | None = None) -> DataFrame:
    """Per input row: `id`, `host`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, staged.

    A null or empty text has no words and no lines. A row stands by itself, without a shuffle, but for
    texts of over `long_text` bytes (1 MB), which are measured in pieces to the same numbers (`_measure_long`).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    short = stage(_measure_short(rows.where(~is_long(F.col("text"), long_text))), "rules")
    longer = stage(rows.where(is_long(F.col("text"), long_text)).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    if not longer.limit(1).count():
        return short
    return short.unionByName(stage(_measure_long(longer, long_text), "long-rules"))


def _key(value: Column) -> Column:
    """A string by itself, or by its SHA-256 where it is long."""
    return F.when(F.length(value) <= 200, value).otherwise(F.sha2(value, 256))


def _measure_long(rows: DataFrame, size: int | None) -> DataFrame:
    """The measures of long texts by pieces: words, their 3-word windows with their places, and lines are rows that Spark counts."""
    texts = rows.select("row", "text")
    parts = stage(pieces(texts, ["row"], r"[\x20\x09-\x0D]", size), "pieces")
    sums = parts.groupBy("row").agg(F.sum(F.size(words_of(F.col("text")))).cast("long").alias("n_words"), F.sum(_word_chars("text")).alias("word_chars"), F.sum(_symbols("text")).alias("n_symbols"))
    words = with_next(parts.select("row", "part", words_of(F.col("text")).alias("words")), ["row"], "words", 2)
    words = words.select("row", "before", F.concat("words", "after").alias("w")).where(F.size("w") > 2)
    n = F.size("w")
    three = F.zip_with(F.zip_with(F.slice("w", 1, n - 2), F.slice("w", 2, n - 2), lambda a, b: F.concat(a, F.lit(" "), b)), F.slice("w", 3, n - 2), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = words.select("row", "before", F.posexplode(three).alias("i", "w")).select("row", (F.col("before") + F.col("i")).alias("at"), _key(F.col("w")).alias("w"))
    windows = stage(windows, "windows")
    twice = windows.groupBy("row", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("row", "w")
    at = windows.join(twice, ["row", "w"]).select("row", F.explode(F.array(*[F.col("at") + i for i in range(3)])).alias("at")).groupBy("row", "at").agg(F.lit(1).alias("one"))
    repeated = at.groupBy("row").agg(F.count(F.lit(1)).alias("n_repeat_words"))
    lines = pieces(texts, ["row"], r"\n", size).select("row", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(WORD))
    lines = lines.groupBy("row", _key(F.col("line")).alias("line")).agg((F.count(F.lit(1)) - 1).alias("again")).groupBy("row").agg(F.sum("again").alias("n_dup_lines"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = rows.select("id", "host", "row").join(sums, "row").join(repeated, "row", "left").join(lines, "row", "left")
    return out.select("id", "host", "n_words", "word_chars", "n_symbols", zero("n_dup_lines"), zero("n_repeat_words"))


def _measure_short(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "id", "host", "n", _word_chars("text").alias("word_chars"), _symbols("text").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.when(F.col("n") >= 4, repeated_words(F.col("words"), F.col("n")))).alias("sorted"),
    )
    # Each window beside the one before it and the one after it in sorted order.
    none = F.struct(F.lit(None).cast("string").alias("w"), F.lit(-1).alias("i"))
    s, m = F.col("sorted"), F.size("sorted")
    before = F.zip_with(s, F.concat(F.array(none), F.slice(s, 1, F.greatest(m - 1, F.lit(0)))), lambda a, b: F.struct(a["i"].alias("i"), (a["w"] == b["w"]).alias("same"), a["w"].alias("w")))
    both = F.zip_with(before, F.slice(s, 2, F.greatest(m, F.lit(1))), lambda a, b: F.when(F.coalesce(a["same"], F.lit(False)) | F.coalesce(a["w"] == b["w"], F.lit(False)), a["i"]))
    rows = rows.withColumn("places", F.sort_array(F.filter(both, lambda i: i.isNotNull())))
    return rows.select("id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def poor() -> Column:
    """The softer rules that hosts are judged by: symbols above a tenth of the words, many repeated lines or windows, words of odd mean length."""
    n = F.col("n_words")
    return (n == 0) | (F.col("n_symbols") * 10 > n) | (F.col("n_dup_lines") * 20 > n) | (F.col("n_repeat_words") * 100 > n * 30) | (F.col("word_chars") > n * 12) | (F.col("word_chars") < n * 2)


def host_verdicts(measured: DataFrame, limit: float = 1.0) -> DataFrame:
    """One row per host: documents, failures, the shrunk failure rate and `bad`.

    A host is bad if its shrunk rate is above the prior's mean by more than `limit` of the prior's
    standard deviations: hosts are judged by what hosts of this corpus are like.

    The prior is a beta distribution with the mean and variance of the hosts' own rates (method
    of moments, hosts weighted alike), so that a host with few documents stays near the mean.
    Failures are counted per task before the shuffle; a host of any size is one row after it.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(base_failed() | poor(), 1).otherwise(0)).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    mean, var = hosts.agg(F.avg(rate), F.var_samp(rate)).first()  # one row
    mean, var = mean or 0.0, var if var == var and var is not None else 0.0
    # Moments that no beta distribution has (no spread, or too much) are moved to the nearest that one has.
    top = max(mean * (1 - mean), 1e-9)
    var = min(max(var, 1e-4), top * 0.999)
    strength = top / var - 1
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > mean + limit * var**0.5).alias("host_bad"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 1.0, long_text: int | None = None) -> DataFrame:
    """Measures, `base_failed` and `kept` per input row.

    A document that fails the base rules goes. Of the others, one that fails a softer rule goes
    if its host is bad (see `host_verdicts`); clean documents stay, whatever their host. A null host is one host; repeated rows count each.
    """
    measured = measure(docs, id_col, text_col, host_col, long_text)
    verdicts = host_verdicts(measured, limit).select(F.col("host").alias("h"), "host_rate", "host_bad")
    out = measured.join(verdicts, F.col("host").eqNullSafe(F.col("h")))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~(F.col("host_bad") & poor())).alias("kept"), F.round("host_rate", 9).alias("host_rate"))
