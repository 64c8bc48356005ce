"""Loss aggregates over scored pixels, and the choice of hard pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.operators.selection import bits_of, double_of, kth_smallest, ordered_bits, smallest
from rasterlake.sources.scratch import stage

IGNORE = 255


def log_softmax(scores: DataFrame, keys: list[str]) -> DataFrame:
    """`logp` of each class's score within its pixel, shifted by the largest score."""
    w = W.Window.partitionBy(*keys)
    rows = scores.withColumn("__m", F.max("score").over(w))
    rows = rows.withColumn("__s", F.sum(F.exp(F.col("score") - F.col("__m"))).over(w))
    return rows.withColumn("logp", F.col("score") - F.col("__m") - F.log("__s")).drop("__m", "__s")


def cross_entropy(logp: DataFrame, weights: dict[int, float] | None = None, average: str = "weights", ignore: int = IGNORE) -> DataFrame:
    """Class-weighted cross entropy of rows with `logp`, `class_id`, `gt`: divided by the weights, by all rows, or by rows not ignored."""
    w: Column = F.lit(1.0) if not weights else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("gt")), F.lit(1.0))
    own = F.when(F.col("gt") != ignore, F.when(F.col("class_id") == F.col("gt"), -w * F.col("logp")))
    first = F.col("class_id") == 0  # one row a pixel to count pixels by
    total = {"weights": F.sum(F.when((F.col("gt") != ignore) & (F.col("class_id") == F.col("gt")), w)), "all": F.sum(F.when(first, 1.0)), "valid": F.sum(F.when(first & (F.col("gt") != ignore), 1.0))}[average]
    return logp.agg(F.try_divide(F.sum(own), total).alias("loss"))


def bce_terms(df: DataFrame, score: str = "score") -> Column:
    """Stable binary cross entropy of a logit against `target`."""
    x, t = F.col(score), F.col("target")
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def one_hot(scores: DataFrame, ignore: int = IGNORE) -> DataFrame:
    """`target` and `valid` of each class's score."""
    return scores.withColumn("target", (F.col("class_id") == F.col("gt")).cast("double")).withColumn("valid", (F.col("gt") != ignore).cast("double"))


def binary_cross_entropy(scores: DataFrame, avg_non_ignore: bool = True) -> DataFrame:
    rows = one_hot(scores)
    total = F.sum("valid") if avg_non_ignore else F.sum(F.lit(1.0))
    return rows.agg((F.sum(bce_terms(rows) * F.col("valid")) / total).alias("loss"))


def focal(scores: DataFrame, gamma: float = 2.0, alpha: float = 0.5) -> DataFrame:
    rows = one_hot(scores)
    p = 1 / (1 + F.exp(-F.col("score")))
    t = F.col("target")
    miss = (1 - p) * t + p * (1 - t)
    term = bce_terms(rows) * (alpha * t + (1 - alpha) * (1 - t)) * F.pow(miss, F.lit(gamma))
    return rows.agg((F.sum(term * F.col("valid")) / F.sum(F.lit(1.0))).alias("loss"))


def dice_loss(probs: DataFrame, smooth: float = 1.0, exponent: int = 2) -> DataFrame:
    """1 - (2 sum p t + s) / (sum p^2 + t^2 + s) by image and class, then the mean."""
    rows = one_hot(probs)
    p, t = F.col("score"), F.col("target")
    num, den = F.sum(p * t * F.col("valid")), F.sum(F.pow(p, F.lit(exponent)) + F.pow(t, F.lit(exponent)))
    each = rows.groupBy("image_id", "class_id").agg((1 - (2 * num + smooth) / (den + smooth)).alias("loss"))
    return each.groupBy("class_id").agg(F.avg("loss").alias("loss"))


def reduce_loss(df: DataFrame, reduction: str = "mean", avg_factor: float | None = None, eps: float = 1.1920928955078125e-07) -> DataFrame:
    """`loss * weight` reduced: none, mean or sum; a factor goes with mean only (or changes nothing with none)."""
    term = F.col("loss") * F.col("weight")
    if reduction == "none":
        return df.withColumn("loss", term)
    if avg_factor is None:
        return df.agg((F.avg(term) if reduction == "mean" else F.sum(term)).alias("loss"))
    if reduction != "mean":
        raise ValueError("a sum is not divided: a factor needs the mean")
    return df.agg((F.sum(term) / (avg_factor + eps)).alias("loss"))


def lovasz_softmax(probs: DataFrame, keys: list[str] | None = None, ignore: int = IGNORE) -> DataFrame:
    """Lovasz extension of the Jaccard loss, by class over present classes (by `keys`, such as the image, first).

    Errors are sorted by class; the gradient is the step of the Jaccard index along that order.
    Ties make no difference to the sum. Without keys the classes of the whole corpus are sorted in
    ranges (`_lovasz_in_ranges`); rows need `pixel`, and with it should differ.
    """
    keys = keys or []
    rows = probs.where(F.col("gt") != ignore).withColumn("fg", (F.col("class_id") == F.col("gt")).cast("double"))
    rows = rows.withColumn("err", F.abs(F.col("fg") - F.col("score")))
    each = _lovasz(rows, [*keys, "class_id"]) if keys else _lovasz_in_ranges(rows, ["class_id"])
    return each.groupBy(*keys).agg(F.avg("loss").alias("loss"))


def _jaccard_step(total: Column, seen: Column, count: Column) -> Column:
    """How far the Jaccard loss moves at a row, from the foreground and rows up to it, itself included."""
    jaccard = lambda s, n: 1 - (total - s) / (total + n - s)
    return jaccard(seen, count) - jaccard(seen - F.col("fg"), count - 1)


def _lovasz(rows: DataFrame, group: list[str]) -> DataFrame:
    """The loss of groups that each fit a task, such as a class of one image."""
    every = W.Window.partitionBy(*group)
    along = every.orderBy(F.desc("err"), "pixel").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum("fg").over(every)).where("total > 0")
    step = _jaccard_step(F.col("total"), F.sum("fg").over(along), F.count(F.lit(1)).over(along))
    return rows.withColumn("step", step).groupBy(*group).agg(F.sum(F.greatest(F.col("err"), F.lit(0.0)) * F.col("step")).alias("loss"))


def _lovasz_in_ranges(rows: DataFrame, group: list[str]) -> DataFrame:
    """The loss of groups of any size, by distributed prefix sums.

    Rows go to sampled ranges of group, error and pixel and are written once, so that the ranges stay
    what they are. What a group has in a range is counted; sums of these few counts give what lies before each
    range, and within a range the rows of a group are summed along. No window spans a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*group, F.desc("err"), "pixel"]
    rows = stage(rows.select(*group, "err", "fg", "pixel").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*group, "part").agg(F.sum("fg").alias("f"), F.count(F.lit(1)).alias("n"))
    every = W.Window.partitionBy(*group)  # as many rows as there are ranges
    before = every.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = counts.select(*group, "part", F.sum("f").over(every).alias("total"), F.coalesce(F.sum("f").over(before), zero).alias("f0"), F.coalesce(F.sum("n").over(before), zero).alias("n0")).where("total > 0")
    along = W.Window.partitionBy(*group, "part").orderBy(F.desc("err"), "pixel").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumn("seen", F.sum("fg").over(along)).withColumn("count", F.count(F.lit(1)).over(along)).join(starts, [*group, "part"])
    step = _jaccard_step(F.col("total"), F.col("seen") + F.col("f0"), F.col("count") + F.col("n0"))
    return rows.withColumn("step", step).groupBy(*group).agg(F.sum(F.greatest(F.col("err"), F.lit(0.0)) * F.col("step")).alias("loss"))


def lovasz_hinge(logits: DataFrame, keys: list[str] | None = None, ignore: int = IGNORE) -> DataFrame:
    """The binary form on logits of class 1: errors are 1 - logit * sign. Without keys all pixels are one group, sorted in ranges."""
    rows = logits.where(F.col("gt") != ignore).withColumn("fg", F.col("gt").cast("double"))
    rows = rows.withColumn("err", 1 - F.col("score") * (2 * F.col("fg") - 1))
    if keys:
        return _lovasz(rows, keys)
    return _lovasz_in_ranges(rows.withColumn("all", F.lit(1)), ["all"]).select("loss")


def hard_by_threshold(df: DataFrame, thresh: float, min_kept: int, n_images: int, key: str = "pixel") -> DataFrame:
    """Weight 1 for rows whose probability of the truth `p` is below max(thresh, the min_kept-per-image smallest).

    The smallest one is found by counting bits (`selection`), whatever its rank: no sort, and nothing
    but counts leaves the tasks. The counts are jobs of their own.
    """
    keys = stage(df.select(ordered_bits(F.col("p")).alias("k")), "keys")
    k = min(min_kept * n_images + 1, keys.count())
    found = kth_smallest(keys, "k", k)
    bar = int(bits_of(np.array([float(thresh)]))[0])
    if found is not None:
        bar = max(bar, found[0])
    return df.withColumn("weight", (F.col("p").isNotNull() & (F.col("p").cast("double") < F.lit(double_of(bar)))).cast("double"))


def hard_by_loss(df: DataFrame, min_kept: int, n_images: int, key: str = "pixel") -> DataFrame:
    """Weight 1 for the largest losses, `min_kept` per image in all, ties by smaller key (a whole number); found by counting bits, without a sort or join."""
    loss = F.bitwise_not(ordered_bits(F.col("loss")))
    keys = df.select(loss.alias("__loss"), F.col(key).cast("long").alias("__key"))
    chosen = smallest(stage(keys, "keys"), min_kept * n_images)
    rows = df.withColumn("__loss", loss).withColumn("__key", F.col(key).cast("long"))
    return rows.withColumn("weight", chosen.cast("double")).drop("__loss", "__key")


def uncertainty(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Second best minus best score: near 0 where a pixel is uncertain."""
    rank = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc("score"), "class_id"))
    top = scores.withColumn("__r", rank).where("__r <= 2")
    return top.groupBy(*keys).agg((F.max(F.when(F.col("__r") == 2, F.col("score"))) - F.max(F.when(F.col("__r") == 1, F.col("score")))).alias("uncertainty"))


def most_uncertain(points: DataFrame, n: int, key: str = "image_id") -> DataFrame:
    """The n most uncertain pixels by image, with centres in [0, 1] (points have h and w)."""
    rank = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc("uncertainty"), "y", "x"))
    return points.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "y", "x", "rank", "uncertainty", ((F.col("x") + 0.5) / F.col("w")).alias("cx"), ((F.col("y") + 0.5) / F.col("h")).alias("cy"))


def importance_sample(points: DataFrame, n: int, oversample: float, share: float, order: Column, key: str = "image_id") -> DataFrame:
    """Of n * oversample drawn pixels the most uncertain share, filled up to n with further drawn ones."""
    by_draw = F.row_number().over(W.Window.partitionBy(key).orderBy(order, "y", "x"))
    rows = points.withColumn("__d", by_draw)
    pool, best = int(n * oversample), int(share * n)
    first = rows.where(F.col("__d") <= pool)
    rank = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc("uncertainty"), "y", "x"))
    sure = first.withColumn("__r", rank).where(F.col("__r") <= best).drop("__r").withColumn("kind", F.lit("important"))
    rest = rows.where((F.col("__d") > pool) & (F.col("__d") <= pool + n - best)).withColumn("kind", F.lit("random"))
    return sure.unionByName(rest).drop("__d")
