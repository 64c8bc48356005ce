"""Derived tables over the driver's tables, in Spark and, for checks, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.functions.scalars import normalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pixels of images that one task makes.
PIXELS = 1 << 18


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per supplier, of six sizes; dealt to tasks by the number of their pixels, as the table is one small file whose rows become a thousand pixels each."""
    k = F.col("s_suppkey").cast("long")
    rows = table(spark, sf_dir, "supplier").select(k.alias("image_id"), (24 + 8 * (k % 3)).alias("h"), (32 + 8 * (k % 2)).alias("w"))
    pixels = rows.agg(F.sum(F.col("h") * F.col("w"))).first()[0] or 0
    return rows.repartition(pixels // PIXELS + 1, "image_id")


def grid(images_: DataFrame) -> DataFrame:
    """All pixels of images of size h, w."""
    return images_.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))


def raster(spark: SparkSession, sf_dir: str, images_: DataFrame | None = None) -> DataFrame:
    """Ground truth, prediction (6 classes, 255 to ignore) and colour per pixel, of all images or of those given."""
    i, y, x = F.col("image_id"), F.col("y"), F.col("x")
    g = grid(images(spark, sf_dir) if images_ is None else images_).withColumn("c", (i + 2 * F.floor(y / 12) + 3 * F.floor(x / 14)) % 6)
    c = F.col("c")
    return g.select(
        "image_id", "h", "w", "y", "x", F.when((y * 41 + x + i) % 17 == 0, 255).otherwise(c).cast("int").alias("gt"), F.when((7 * i + 3 * y + 5 * x) % 11 < 2, (c + 1) % 6).otherwise(c).cast("int").alias("pred"),
        ((c * 40 + y) % 256).cast("int").alias("r"), ((c * 25 + x) % 256).cast("int").alias("g"), ((i * 9 + c * 11) % 256).cast("int").alias("b"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of 10 x 10 unit vectors, one graph an image, with a label."""
    v = F.col("vec_id").cast("long")
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 100).alias("image_id"), (v % 100).alias("node"), F.floor(v % 100 / 10).alias("py"), (v % 10).alias("px"), F.col("label").cast("int").alias("gt"), F.col("embedding").cast("array<double>").alias("feat"))


def class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised mean vector of each label."""
    d = patches(spark, sf_dir).select("gt", F.posexplode("feat").alias("d", "v")).groupBy("gt", "d").agg(F.avg("v").alias("v"))  # summed within tasks first
    return d.groupBy(F.col("gt").alias("class_id")).agg(normalise(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda s: s["v"])).alias("class_feat"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, epochs (dates, as days since 2000) and steps with a loss; an epoch's events are its steps."""
    e = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.to_date("ts"), F.to_date(F.lit("2000-01-01"))).cast("long"))
    order = W.Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("run_id"), F.col("day").alias("epoch"), F.row_number().over(order).cast("long").alias("step"), F.col("value").alias("loss"), "props", "event_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with mixed-case extensions and one to reject."""
    p = F.col("page_id")
    end = F.when(p % 5 == 0, ".JPG").when(p % 11 == 0, ".txt").otherwise(".png")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("h"), (p % 7).cast("string"), F.lit("-IMG_"), p.cast("string"), end).alias("file_name"), "page_id")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large flat table of pixel pairs: an image per order."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("image_id"), flag.alias("gt"), F.when(F.col("l_linestatus") == "F", flag).otherwise((flag + 1) % 3).alias("pred"))


def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label and prediction per labelled document: a skewed case of two classes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("image_id"), F.col("quality").cast("int").alias("gt"), (F.col("n_chars") >= 500).cast("int").alias("pred"))


#: The same tables for DuckDB.
DUCK = {
    "v_image": "select cast(s_suppkey as bigint) image_id, cast(24 + 8 * (s_suppkey % 3) as bigint) h, cast(32 + 8 * (s_suppkey % 2) as bigint) w from supplier",
    "v_raster": """select image_id, h, w, y, x, cast(case when (y * 41 + x + image_id) % 17 = 0 then 255 else c end as int) gt,
      cast(case when (7 * image_id + 3 * y + 5 * x) % 11 < 2 then (c + 1) % 6 else c end as int) pred,
      cast((c * 40 + y) % 256 as int) r, cast((c * 25 + x) % 256 as int) g, cast((image_id * 9 + c * 11) % 256 as int) b
      from (select *, (image_id + 2 * (y // 12) + 3 * (x // 14)) % 6 c from (select *, unnest(range(w)) x from (select *, unnest(range(h)) y from v_image)))""",
    "v_patch": "select cast(vec_id // 100 as bigint) image_id, cast(vec_id % 100 as bigint) node, cast(vec_id % 100 // 10 as bigint) py, cast(vec_id % 10 as bigint) px, cast(label as int) gt, cast(embedding as double[]) feat from embeddings",
    "v_class_raw": "select gt, list(v order by d) m from (select gt, d, avg(v) v from (select gt, unnest(range(len(feat))) d, unnest(feat) v from v_patch) group by gt, d) group by gt",
    "v_class": "select gt class_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda q: q * q)))) class_feat from v_class_raw",
    "v_step": "select event_type run_id, date_diff('day', date '2000-01-01', cast(ts as date)) epoch, cast(row_number() over (partition by event_type, cast(ts as date) order by ts, event_id) as bigint) step, value loss, props, event_id from events",
    "v_file": "select concat('h', page_id % 7, '-IMG_', page_id, case when page_id % 5 = 0 then '.JPG' when page_id % 11 = 0 then '.txt' else '.png' end) file_name, page_id from pages",
    "v_pair": "select cast(l_orderkey as bigint) image_id, f gt, case when l_linestatus = 'F' then f else (f + 1) % 3 end pred from (select *, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end f from lineitem)",
    "v_doc": "select l.doc_id image_id, cast(quality as int) gt, cast(case when n_chars >= 500 then 1 else 0 end as int) pred from labels l join documents d on l.doc_id = d.doc_id",
}
_NEEDS = {"v_raster": ["v_image"], "v_class": ["v_patch", "v_class_raw"], "v_class_raw": ["v_patch"]}


def duck(views: str, select: str, **ctes: str) -> str:
    """SQL text with the named views, and further ones in order, before a select."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    parts = [f"{n} as materialized ({DUCK[n]})" for n in names] + [f"{n} as materialized ({s})" for n, s in ctes.items()]
    return f"with {', '.join(parts)} {select}"


def duck_draw(key: str, salt: int | str = 0) -> str:
    """`scalars.draw` as SQL."""
    h1 = f"((cast({key} as bigint) * 48271 + {salt} * 16807 + 12345) % 2147483647)"
    h2 = f"((({h1} * {h1}) % 2147483647 * 69621 + {h1}) % 2147483647)"
    return f"((({h2} * {h2}) % 2147483647 * 16807 + {h2}) % 2147483647)"
