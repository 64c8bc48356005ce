"""Run logs: series, moving means, best checkpoints and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def moving_mean(df: DataFrame, size: int = 100, value: str = "loss") -> DataFrame:
    """The mean of the last `size` values of a run's epoch, of fewer at its start."""
    w = W.Window.partitionBy("run_id", "epoch").orderBy("step").rowsBetween(1 - size, 0)
    return df.withColumn(f"{value}_mean", F.avg(value).over(w))


def epoch_loss(df: DataFrame, loss: str = "loss", batch: str = "batch") -> DataFrame:
    """Batch losses weighted by batch size."""
    return df.groupBy("run_id", "epoch").agg((F.sum(F.col(loss) * F.col(batch)) / F.sum(batch)).alias("loss"))


def metric_delta(df: DataFrame, value: str = "loss") -> DataFrame:
    return df.withColumn("delta", F.col(value) - F.lag(value).over(W.Window.partitionBy("run_id").orderBy("epoch")))


def best_checkpoints(df: DataFrame, k: int = 3, value: str = "loss") -> DataFrame:
    """Each run's k smallest values, kept; the others, marked for deletion."""
    rank = F.row_number().over(W.Window.partitionBy("run_id").orderBy(value, "epoch"))
    return df.withColumn("kept", rank <= k)


def best_epoch(df: DataFrame, value: str, greater: bool = True) -> DataFrame:
    """The epoch of each run's best value, the first of equal ones."""
    v = F.col(value) if greater else -F.col(value)
    return df.groupBy("run_id").agg(F.max_by("epoch", F.struct(v, -F.col("epoch"))).alias("epoch"), (F.max(value) if greater else F.min(value)).alias(value))


def loss_totals(df: DataFrame) -> DataFrame:
    """The mean by name of (step, name, value) and, as `loss`, the sum over names that contain "loss"; parts of one name add up within a step."""
    steps = df.groupBy("name", "step").agg(F.sum("value").alias("value"))
    means = steps.groupBy("name").agg(F.avg("value").alias("value"))
    total = means.where(F.contains("name", F.lit("loss"))).agg(F.lit("loss").alias("name"), F.sum("value").alias("value"))
    return means.unionByName(total)


def compare_runs(base: DataFrame, tuned: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both runs' values and their differences, also for keys that one run lacks."""
    b = base.select(*keys, *[F.col(v).alias(f"base_{v}") for v in values])
    t = tuned.select(*keys, *[F.col(v).alias(f"tuned_{v}") for v in values])
    out = b.join(t, keys, "full")
    return out.withColumns({f"delta_{v}": F.col(f"tuned_{v}") - F.col(f"base_{v}") for v in values})


def class_series(log: DataFrame) -> DataFrame:
    """A row per epoch and class of logs with nested class metrics."""
    m = log.select("epoch", F.explode("metrics.class_metrics").alias("name", "m"))
    return m.select("epoch", "name", "m.iou", "m.f1", "m.accuracy")


def run_name(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))


def summary_json(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One JSON line of name to value for both runs."""

    def side(df: DataFrame) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("m"))

    b, t = side(base).withColumnRenamed("m", "base"), side(tuned).withColumnRenamed("m", "finetuned")
    return b.join(F.broadcast(t)).select(F.to_json(F.struct("base", "finetuned")).alias("value"))  # one row each
