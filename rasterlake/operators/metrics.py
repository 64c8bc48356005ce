"""Evaluation of label maps: areas, confusion, IoU, Dice, F-score, groups, boundaries, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.operators.boxes import boundary_counts, boundary_pixels

IGNORE = 255


def _spine(df: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """Every class for every key that `df` has."""
    keyed = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return keyed.withColumn("class_id", F.explode(F.array(*[F.lit(c) for c in range(n_classes)])))


#: Up to so many classes an image's counts are columns of one row.
FEW_CLASSES = 8


def areas_per_image(df: DataFrame, n_classes: int, ignore: int = IGNORE, key: str = "image_id") -> DataFrame:
    """Intersection, prediction, ground-truth and union pixels by image and class.

    Pixels to ignore leave all counts; labels outside 0..C-1 count nowhere. One aggregation over
    the pixels. With few classes an image's counts are columns of one group, so that nothing is shuffled
    or grouped again; otherwise pairs of labels are counted per task before the shuffle, and the
    classes are made from those few rows.
    """
    if n_classes <= FEW_CLASSES:
        kept, sides = df.where(F.col("gt") != ignore), {}
        for c in range(n_classes):
            hits = {"i": (F.col("gt") == c) & (F.col("pred") == c), "p": F.col("pred") == c, "g": F.col("gt") == c}
            sides |= {f"{k}{c}": F.count(F.when(hit, 1)).alias(f"{k}{c}") for k, hit in hits.items()}
        rows = kept.groupBy(key).agg(*sides.values())
        return rows.select(key, F.inline(F.array(*[
            F.struct(F.lit(c).alias("class_id"), F.col(f"i{c}").alias("a_inter"), (F.col(f"p{c}") + F.col(f"g{c}") - F.col(f"i{c}")).alias("a_union"), F.col(f"p{c}").alias("a_pred"), F.col(f"g{c}").alias("a_gt"))
            for c in range(n_classes)
        ])))
    pairs = df.where(F.col("gt") != ignore).groupBy(key, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("gt").alias("class_id"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("i"), F.lit(0).cast("long").alias("p"), F.col("n").alias("g")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("i"), F.col("n").alias("p"), F.lit(0).cast("long").alias("g")),
        *[F.struct(F.lit(c).alias("class_id"), *[F.lit(0).cast("long").alias(k) for k in "ipg"]) for c in range(n_classes)],
    )
    rows = pairs.select(key, F.inline(sides)).where(f"class_id between 0 and {n_classes - 1}")
    out = rows.groupBy(key, "class_id").agg(F.sum("i").alias("a_inter"), F.sum("p").alias("a_pred"), F.sum("g").alias("a_gt"))
    return out.select(key, "class_id", "a_inter", (F.col("a_pred") + F.col("a_gt") - F.col("a_inter")).alias("a_union"), "a_pred", "a_gt")


def total_areas(areas: DataFrame, by: list[str] | None = None) -> DataFrame:
    return areas.groupBy(*(by or []), "class_id").agg(*[F.sum(c).alias(c) for c in ("a_inter", "a_union", "a_pred", "a_gt")])


def _ratio(a: Column, b: Column, absent: str) -> Column:
    """a / b; without either, NULL (skipped by means) or 0."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return F.coalesce(r, F.lit(0.0)) if absent == "zero" else r


def class_metrics(totals: DataFrame, beta: float = 1.0, absent: str = "skip") -> DataFrame:
    """IoU, accuracy, Dice, precision, recall and F-score by class."""
    i, u, p, g = (F.col(c) for c in ("a_inter", "a_union", "a_pred", "a_gt"))
    precision, recall = _ratio(i, p, absent), _ratio(i, g, absent)
    f = _ratio((1 + beta**2) * precision * recall, beta**2 * precision + recall, absent)
    return totals.select(
        *[c for c in totals.columns if not c.startswith("a_")], _ratio(i, u, absent).alias("iou"), _ratio(i, g, absent).alias("acc"), _ratio(2 * i, p + g, absent).alias("dice"),
        precision.alias("precision"), recall.alias("recall"), f.alias("fscore"),
    )


def mean_metrics(totals: DataFrame, beta: float = 1.0, absent: str = "skip", by: list[str] | None = None) -> DataFrame:
    """Overall accuracy and the means of the class metrics over present classes."""
    overall = totals.groupBy(*(by or [])).agg(F.try_divide(F.sum("a_inter").cast("double"), F.sum("a_gt").cast("double")).alias("a_acc"))
    means = class_metrics(totals, beta, absent).groupBy(*(by or [])).agg(*[F.avg(c).alias(f"m_{c}") for c in ("iou", "acc", "dice", "precision", "recall", "fscore")])
    return overall.join(means, by) if by else overall.join(F.broadcast(means))  # one row each without `by`


def nan_to_num(df: DataFrame, value: float = 0.0) -> DataFrame:
    return df.na.fill(value)


#: Metric names that a summary can be asked for, and their columns.
METRICS = {"mIoU": ["iou", "acc"], "mDice": ["dice", "acc"], "mFscore": ["fscore", "precision", "recall"]}


def dataset_evaluate(totals: DataFrame, metrics: list[str], names: dict[int, str]) -> DataFrame:
    """Flat keys and values: the overall accuracy, means, and `IoU.<class>`, in percent of two digits, half to even, and back."""
    if unknown := set(metrics) - set(METRICS):
        raise KeyError(f"metrics {sorted(unknown)} are not supported")
    wanted = list(dict.fromkeys(c for m in metrics for c in METRICS[m]))
    title = {"iou": "IoU", "acc": "Acc", "dice": "Dice", "fscore": "Fscore", "precision": "Precision", "recall": "Recall"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("class_id"))
    per_class = class_metrics(totals).withColumn("name", name).unpivot("name", wanted, "metric", "v")
    labels = F.create_map(*[F.lit(x) for c in wanted for x in (c, title[c])])
    per_class = per_class.select(F.concat(F.element_at(labels, F.col("metric")), F.lit("."), "name").alias("key"), (F.bround(F.col("v") * 100, 2) / 100).alias("value"))
    means = mean_metrics(totals).select(F.col("a_acc").alias("aAcc"), *[F.col(f"m_{c}").alias(f"m{title[c]}") for c in wanted])
    means = means.unpivot([], list(means.columns), "key", "v").select("key", (F.bround(F.col("v") * 100, 2) / 100).alias("value"))
    return per_class.unionByName(means)


def confusion_matrix(df: DataFrame, n_classes: int, ignore: int = IGNORE, by: list[str] | None = None) -> DataFrame:
    """Pixels by ground truth and prediction, zero cells included."""
    keys = by or []
    inside = df.where((F.col("gt") != ignore) & F.col("gt").between(0, n_classes - 1) & F.col("pred").between(0, n_classes - 1))
    counted = inside.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    classes = F.array(*[F.lit(c) for c in range(n_classes)])
    base = (inside.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).withColumn("gt", F.explode(classes)).withColumn("pred", F.explode(classes))
    return base.join(counted, [*keys, "gt", "pred"], "left").select(*keys, "gt", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def confusion_wide(confusion: DataFrame, n_classes: int) -> DataFrame:
    return confusion.groupBy("gt").pivot("pred", list(range(n_classes))).agg(F.sum("n"))


def confusion_counts(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True and false positives and false negatives by class."""
    sides = F.array(
        F.struct(F.col("gt").alias("class_id"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("gt") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("tp"), F.when(F.col("gt") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    return confusion.select(*(by or []), F.inline(sides)).groupBy(*(by or []), "class_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def _from_counts(df: DataFrame, keep: list[str]) -> DataFrame:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.select(*keep, "tp", "fp", "fn", ratio(tp, tp + fp + fn).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fn).alias("accuracy"))


def metrics_from_confusion(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """IoU, F1 and accuracy by class; absent classes count as 0."""
    return _from_counts(confusion_counts(confusion, by), [*(by or []), "class_id"])


def group_metrics_collapsed(confusion: DataFrame, groups: dict[str, list[int]], combined: str = "COMBINED_GROUPS") -> DataFrame:
    """Each group as one class: cells inside its block are true; `combined` is the union of all groups."""
    every = groups | {combined: sorted({c for g in groups.values() for c in g})}
    member = F.array(*[F.struct(F.lit(k).alias("group_name"), F.array(*[F.lit(c) for c in v]).alias("members")) for k, v in every.items()])
    rows = confusion.select("gt", "pred", "n", F.inline(member))
    g, p = F.array_contains("members", F.col("gt")), F.array_contains("members", F.col("pred"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return _from_counts(rows.groupBy("group_name").agg(total(g & p).alias("tp"), total(~g & p).alias("fp"), total(g & ~p).alias("fn")), ["group_name"])


def group_metrics_mean(per_class: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """Means of IoU and Dice over a group's present classes; NULL for a group without any."""
    member = F.array(*[F.struct(F.lit(k).alias("group_name"), F.lit(c).alias("class_id")) for k, v in groups.items() for c in v])
    rows = per_class.sparkSession.range(1).select(F.inline(member))
    return rows.join(per_class, "class_id", "left").groupBy("group_name").agg(F.avg("iou").alias("iou"), F.avg("dice").alias("dice"))


def class_histogram(df: DataFrame, key: str = "image_id", label: str = "gt") -> DataFrame:
    return df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, n_classes: int, label: str = "gt", ignore: int = IGNORE) -> DataFrame:
    """Inverse frequencies of mean 1; a class to ignore gets 0."""
    counted = df.groupBy(F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = _spine(df, [], n_classes).join(counted, "class_id", "left").withColumn("inv", 1 / (F.coalesce("n", F.lit(0)) + 1))
    return rows.select("class_id", F.when(F.col("class_id") == ignore, 0.0).otherwise(F.col("inv") / F.avg("inv").over(W.Window.partitionBy())).alias("weight"))


def present_classes(df: DataFrame, key: str = "image_id", ignore: int = IGNORE) -> DataFrame:
    """Classes of ground truth or prediction by image."""
    return df.select(key, F.explode(F.array("gt", "pred")).alias("class_id")).where(F.col("class_id") != ignore).distinct()


def boundary_width(h: Column, w: Column, ratio: float = 0.02) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(ratio) * F.sqrt(h * h + w * w)).cast("int"))


def boundary_mask(mask: DataFrame, d: int | Column, key: str = "image_id", label: str = "label") -> DataFrame:
    """`key, y, x, label` of the pixels of each class within d steps of another class or of the frame.

    A pixel is inside if all (2d+1)^2 pixels around it have its class, which two summed-area tables
    of a tile tell by four look-ups each, for any d, also one that differs by image (`boxes`).
    """
    return boundary_pixels(mask, d, key, label)


def boundary_areas(df: DataFrame, ratio: float = 0.02, ignore: int = IGNORE, key: str = "image_id") -> DataFrame:
    """Areas of boundary masks by image and class, over the classes in ground truth or prediction.

    `df` has h and w, which give each image's width of the boundary. One pass over tiles of the images, of any widths.
    """
    pairs = df.withColumn("pred", F.when(F.col("gt") == ignore, ignore).otherwise(F.col("pred")))
    return boundary_counts(pairs, boundary_width(F.col("h"), F.col("w"), ratio), ignore, key)


def average_over_datasets(results: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return results.groupBy(metric).agg(F.avg(value).alias(value))


def concat_eval(areas: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Mean IoU of each dataset and, with dataset NULL, of all together."""
    totals = areas.groupingSets([[F.col(dataset), F.col("class_id")], [F.col("class_id")]], dataset, "class_id").agg(*[F.sum(c).alias(c) for c in ("a_inter", "a_union", "a_pred", "a_gt")])
    return class_metrics(totals).groupBy(dataset).agg(F.avg("iou").alias("m_iou"), F.avg("acc").alias("m_acc"))


def topk_accuracy(scores: DataFrame, keys: list[str], topk: tuple[int, ...] = (1,), threshold: float | None = None, ignore: int = IGNORE, eps: float = 1.1920928955078125e-07) -> DataFrame:
    """Percent of rows whose class is among the k highest scores (and above a threshold).

    `scores` has a row per class with `score`, `class_id` and `gt`.
    """
    rank = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc("score"), "class_id"))
    hit = F.col("class_id") == F.col("gt")
    if threshold is not None:
        hit = hit & (F.col("score") > threshold)
    found = scores.where(F.col("gt") != ignore).withColumn("rank", rank).groupBy(*keys).agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))
    n = F.count(F.lit(1))
    return found.agg(*[(100.0 * (F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)) + eps) / (n + eps)).alias(f"top{k}") for k in topk])


def argmax_label(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The class of the highest score; the first of equal ones."""
    return scores.groupBy(*keys).agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).alias("label"))


def rank_classes(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc("score"), "class_id")))
