"""Logs and evaluation as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.sources.files import METRICS_LOG


def tail_metrics_log(spark: SparkSession, folder: str) -> DataFrame:
    """The latest record of each log file as records are appended; for complete or update mode."""
    log = spark.readStream.schema(METRICS_LOG).json(folder).withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return log.groupBy("run_id").agg(F.max_by(F.struct("epoch", "train_loss", "val_loss", F.col("metrics.mIoU").alias("mIoU")), "epoch").alias("last")).select("run_id", "last.*")


def progressive_areas(areas: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Class totals while rows of (image, class) areas arrive; an image that arrives twice counts once.

    State: one row per class, and per image and class seen within the watermark.
    """
    once = areas.withWatermark(time, delay).dropDuplicatesWithinWatermark(["image_id", "class_id"])
    return once.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("a_inter", "a_union", "a_pred", "a_gt")])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, and returns the table at `path` that holds its last result; nothing goes through the driver."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(path)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
