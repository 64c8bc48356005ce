"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.scratch import drop, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`v, c`: each linked vertex and the smallest vertex that links lead to.

    Labels take the least label of the neighbours and then their label's own label, so that a
    path of n links settles in about log n rounds. Each round is written to the shared folder.
    Null ends and links to oneself are ignored; an empty table gives an empty one.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = links.select(F.col(a).alias("v"), F.col(b).alias("w")).unionByName(links.select(F.col(b).alias("v"), F.col(a).alias("w"))).distinct()
    edges = stage(edges, "edges")
    labels = stage(edges.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("c")).withColumn("moved", F.lit(True)), "labels")
    while labels.where("moved").limit(1).count():
        near = edges.join(labels.select(F.col("v").alias("w"), "c"), "w").groupBy("v").agg(F.min("c").alias("near"))
        new = labels.select("v", F.col("c").alias("was")).join(near, "v").withColumn("c", F.least("was", "near"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("far"))
        new = new.join(jump, "c", "left").select("v", "was", F.least("c", F.coalesce("far", "c")).alias("c"))
        new = stage(new.select("v", "c", (F.col("c") != F.col("was")).alias("moved")), "labels")
        drop(labels)
        labels = new
    return labels.select("v", "c")
