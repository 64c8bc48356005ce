"""Run logs, COCO documents, listings and written outputs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from urllib.parse import quote

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

_VALUES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("iou", "f1", "accuracy")])
METRICS_LOG = T.StructType([
    T.StructField("epoch", T.LongType()), T.StructField("train_loss", T.DoubleType()), T.StructField("val_loss", T.DoubleType()),
    T.StructField("metrics", T.StructType([*[T.StructField(n, T.DoubleType()) for n in ("mIoU", "mF1", "mAcc")], T.StructField("class_metrics", T.MapType(T.StringType(), _VALUES)), T.StructField("group_metrics", T.MapType(T.StringType(), _VALUES))])),
])
COCO = (
    "images array<struct<id: long, file_name: string, width: int, height: int>>, categories array<struct<id: long, name: string>>, "
    "annotations array<struct<id: long, image_id: long, category_id: long, segmentation: string>>"
)


def read_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record a line, blank lines skipped."""
    return spark.read.schema(METRICS_LOG).json(path)


def write_metrics_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest_from_dir(spark: SparkSession, folder: str, suffix: str, mask_suffix: str | None = None) -> DataFrame:
    """All files below a folder with the suffix: `file_name`, `mask_name` (the name with the masks' suffix instead) and `path`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    mask = F.concat(F.expr(f"left(file_name, length(file_name) - {len(suffix)})"), F.lit(mask_suffix if mask_suffix is not None else suffix))
    return files.select(name.alias("file_name"), "path").select("file_name", mask.alias("mask_name"), "path").orderBy("file_name")


def manifest_from_split(spark: SparkSession, path: str, img_suffix: str, seg_suffix: str) -> DataFrame:
    """One stem a line."""
    stem = F.trim("value")
    return spark.read.text(path).where(F.length(stem) > 0).select(F.concat(stem, F.lit(img_suffix)).alias("file_name"), F.concat(stem, F.lit(seg_suffix)).alias("mask_name"))


def _images(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")
    return rows.select(F.xxhash64("origin").alias("image_id"), "origin", F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("n_channels"), "data")


def unreadable_images(spark: SparkSession, path: str) -> DataFrame:
    """`origin` of the files below a path that are no images."""
    return _images(spark, path).where("h < 0").select("origin")


def _decoded(spark: SparkSession, path: str, invalid: str) -> DataFrame:
    if invalid not in ("error", "skip"):
        raise ValueError("invalid is error or skip")
    rows = _images(spark, path)
    if invalid == "skip":
        return rows.where("h >= 0")
    broken = F.raise_error(F.concat(F.lit("not an image: "), "origin")).cast("int")
    return rows.withColumn("n_channels", F.when(F.col("h") >= 0, F.col("n_channels")).otherwise(broken))  # which every use of the rows tests


def _colours(images: DataFrame) -> DataFrame:
    """Colour pixels of images of three or four channels, of which the source has blue first; alpha is left out."""
    from rasterlake.operators.raster import unpack

    swap = lambda df: df.withColumnsRenamed({"r": "__b", "b": "r"}).withColumnRenamed("__b", "b")
    return swap(unpack(images.where("n_channels = 3"), 3)).unionByName(swap(unpack(images.where("n_channels = 4"), 4).drop("a")))


def load_image(spark: SparkSession, path: str, invalid: str = "error") -> DataFrame:
    """Pixels of all images below a path by Spark's image source: image_id, origin, h, w, y, x, r, g, b.

    Grey images have three equal values; an alpha channel is left out. A file that is no image is an
    error that names it, or with `invalid` "skip" left out (`unreadable_images` lists such files).
    """
    from rasterlake.operators.raster import unpack

    images = _decoded(spark, path, invalid)
    gray = unpack(images.where("n_channels = 1")).withColumns({c: F.col("label") for c in "rgb"}).drop("label")
    return gray.unionByName(_colours(images)).join(images.select("image_id", "origin"), "image_id")


def load_mask(spark: SparkSession, path: str, palette: DataFrame | None = None, invalid: str = "error") -> DataFrame:
    """Label pixels of all masks below a path: image_id, origin, h, w, y, x, label.

    A grey mask holds its labels. An indexed mask comes out of the image source in its colours: with
    a `palette` (class_id, r, g, b) each colour is its class again, an alpha channel left out; a colour
    that is in none, or a coloured mask without a palette, is an error. Files that are no images: as in `load_image`.
    """
    from rasterlake.operators.raster import unpack

    images = _decoded(spark, path, invalid)
    keys = images.select("image_id", "origin")
    gray = unpack(images.where("n_channels = 1"))
    coloured = images.where("n_channels > 1")
    if palette is None:
        message = F.concat(F.lit("a coloured mask needs a palette: "), "origin")
        labels = coloured.select("image_id", "h", "w", *[F.lit(0).cast("long").alias(c) for c in ("y", "x")], F.raise_error(message).cast("int").alias("label"))
    else:
        named = _colours(coloured).join(palette.select(F.col("class_id").alias("label"), "r", "g", "b"), ["r", "g", "b"], "left")
        unknown = F.raise_error(F.concat_ws(" ", F.lit("no class of colour"), "r", "g", "b")).cast("int")
        labels = named.select("image_id", "h", "w", "y", "x", F.coalesce("label", unknown).alias("label"))
    return gray.unionByName(labels).join(keys, "image_id")


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of COCO documents, with the document's path as `doc`; `segmentation` stays JSON text."""
    doc = spark.read.schema(COCO).option("multiLine", "true").json(path).select("*", F.col("_metadata.file_path").alias("doc"))
    return tuple(doc.select(F.inline(c), "doc") for c in ("images", "categories", "annotations"))


def map_categories(annotations: DataFrame, categories: DataFrame, labels: dict[str, int]) -> DataFrame:
    """Annotations with their label id. An annotation's category is that of its own document, where both tables have `doc`.

    An annotation whose category is listed nowhere, a category that `labels` lacks, and one id with
    two names (in a document, or over all where documents are not told apart) are errors.
    """
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    keys = ["doc", "category_id"] if "doc" in annotations.columns and "doc" in categories.columns else ["category_id"]
    listed = categories.withColumnRenamed("id", "category_id").withColumn("name", F.trim("name"))
    found = listed.groupBy(*keys).agg(F.min("name").alias("name"), F.max("name").alias("__other"))
    rows = annotations.join(found, keys, "left")
    error = lambda *words: F.raise_error(F.concat_ws(" ", *words)).cast("int")
    clash = error(F.lit("category"), "category_id", F.lit("is both"), "name", F.lit("and"), "__other")
    unlisted = error(F.lit("no category"), "category_id", F.lit("for annotation"), "id")
    label = F.when(F.col("name").isNull(), unlisted).when(F.col("name") != F.col("__other"), clash).otherwise(F.coalesce(F.element_at(names, F.col("name")), error(F.lit("unknown category"), "name")))
    return rows.withColumn("label", label).drop("__other")


def parse_segmentation(annotations: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons (image_id, ann_id, label, h, w, part, points) and run lengths (image_id, ann_id, label, h, w, counts) out of COCO's `segmentation` text.

    A list holds polygons, each a flat list of x, y, of which those with fewer than three points are
    left out; an object holds `counts`, from 0 and columns first. A null is no mask; compressed
    counts (a string) are an error.
    """
    sizes = images.select(F.col("id").alias("image_id"), F.col("height").alias("h"), F.col("width").alias("w"))
    rows = annotations.select("image_id", F.col("id").alias("ann_id"), "label", "segmentation").join(sizes, "image_id")
    keys = ["image_id", "ann_id", "label", "h", "w"]
    lists = rows.where(F.col("segmentation").rlike(r"^\s*\[")).select(*keys, F.posexplode(F.from_json("segmentation", "array<array<double>>")).alias("part", "flat"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("flat") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("flat", 2 * i + 1).alias("x"), F.element_at("flat", 2 * i + 2).alias("y")))
    polygons = lists.where(F.size("flat") >= 6).select(*keys, "part", pairs.alias("points"))
    is_runs = F.col("segmentation").rlike(r"^\s*\{")
    unknown = F.raise_error(F.concat(F.lit("run lengths that are not a list of numbers, annotation "), F.col("ann_id").cast("string"))).cast("array<bigint>")
    # The error stands under the condition too, as Spark may test counts before it filters rows.
    counts = F.when(is_runs, F.coalesce(F.from_json("segmentation", "counts array<long>")["counts"], unknown))
    return polygons, rows.where(is_runs).select(*keys, counts.alias("counts"))


def annotation_pixels(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels of COCO annotations of either kind: image_id, ann_id, label, y, x."""
    polygons, runs = parse_segmentation(annotations, images)
    return polygon_pixels(polygons).unionByName(rle_pixels(runs)).distinct()


def rle_pixels(rle: DataFrame) -> DataFrame:
    """Pixels of run-length masks (`counts` alternate from 0, columns first; h and w)."""
    runs = rle.select("image_id", "ann_id", "label", "h", "w", F.posexplode("counts").alias("i", "n"))
    end = F.sum("n").over(W.Window.partitionBy("image_id", "ann_id").orderBy("i").rowsBetween(W.Window.unboundedPreceding, 0))
    runs = runs.withColumn("end", end).where((F.col("i") % 2 == 1) & (F.col("n") > 0))
    cells = runs.withColumn("p", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)))
    return cells.select("image_id", "ann_id", "label", (F.col("p") % F.col("h")).alias("y"), F.floor(F.col("p") / F.col("h")).alias("x"))


def polygon_pixels(polygons: DataFrame) -> DataFrame:
    """Pixels of polygons: rows that a polygon crosses, between its crossings (even-odd), and its outline.

    `points` is an array of x, y structs of at least 3; `part`, if there is one, numbers the
    polygons of an annotation. An outline is, for each edge between the rounded corners, one pixel a
    column or row, whichever there are more of, rounded half up.
    """
    part = F.col("part") if "part" in polygons.columns else F.lit(0)
    p = polygons.where(F.size("points") >= 3).withColumn("part", part)
    keys = ["image_id", "ann_id", "part", "label", "h", "w"]
    edges = p.select(*keys, F.posexplode(F.zip_with("points", F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).alias("i", "e")).select("*", "e.*").drop("e")
    lo, hi = F.greatest(F.ceil(F.least("y1", "y2")), F.lit(0)), F.least(F.ceil(F.greatest("y1", "y2")) - 1, F.col("h") - 1)
    lines = edges.where(lo <= hi).withColumn("y", F.explode(F.sequence(lo, hi)))
    cross = lines.withColumn("cx", F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    w = W.Window.partitionBy("image_id", "ann_id", "part", "y").orderBy("cx", "i")
    spans = cross.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("cx").over(w)).where("k % 2 = 1")
    a, b = F.greatest(F.ceil("cx"), F.lit(0)), F.least(F.floor("next"), F.col("w") - 1)
    inside = spans.where(a <= b).select("image_id", "ann_id", "label", F.col("y").cast("long").alias("y"), F.explode(F.sequence(a.cast("long"), b.cast("long"))).alias("x"))
    half = lambda c: F.floor(c + 0.5)
    ends = edges.withColumns({c: half(F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")), F.lit(1))
    steps = ends.withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda i: half(F.col(f"{i}1") + (F.col(f"{i}2") - F.col(f"{i}1")) * F.col("s") / F.col("n"))
    outline = steps.select("image_id", "ann_id", "label", "h", "w", at("y").alias("y"), at("x").alias("x"))
    outline = outline.where("y >= 0 and y < h and x >= 0 and x < w").drop("h", "w")
    return inside.unionByName(outline).distinct()


def paint(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """A label per pixel of `grid`: the last annotation over it, 0 elsewhere."""
    top = cells.groupBy("image_id", "y", "x").agg(F.max_by("label", "ann_id").alias("label"))
    return grid.select("image_id", "y", "x").join(top.hint("merge"), ["image_id", "y", "x"], "left").na.fill(0, ["label"])


def write_split(df: DataFrame, path: str) -> None:
    """A folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_split_lists(df: DataFrame, path: str, suffix: str = "_gtFine_polygons.json") -> None:
    """Text files of stems, a folder per split."""
    df.select("split", F.regexp_replace("file_name", suffix.replace(".", r"\.") + "$", "").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


#: Folders of `write_folders` that one task makes.
FOLDERS = 256


def write_folders(df: DataFrame, column: str, path: str) -> None:
    """A folder for each value of a column, with one text file of the other column's values, below a folder a task.

    Dealt to tasks by the number of rows, as a file takes its time however short it is, and Spark
    would put small rows together in one task. A task moves its own files into place, and readers
    list a task's folders in one task.
    """
    rows = df.repartition(df.count() // FOLDERS + 1, column).withColumn("part", F.spark_partition_id())
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("part", column).text(path)


#: Files of `write_files` that one task makes in one folder, some more or less by the hash.
FILES = 1 << 11


def write_files(df: DataFrame, name: str, value: str, path: str, prefix: str = "", suffix: str = ".txt") -> None:
    """A text file for each value of `name` with a line for each of its rows, many files in a folder, below a new folder.

    Named by `prefix`, the value with all but letters, digits and `_.-~` as % escapes (`unescaped`),
    and `suffix`; without a prefix, Spark's readers leave out names that begin with . or _. A null name is an error.
    Written by pyarrow's file systems (local, S3, GCS, Azure, HDFS): Spark's writer makes a folder a
    file and, on a local disk, starts a program for each folder, file and checksum to set its
    permissions. A task that runs again writes the same files again.
    """

    def write(rows: Iterator[Row]) -> None:
        fs, base = FileSystem.from_uri(path)
        folder = None
        for key, group in groupby(rows, lambda r: r["name"]):
            if key is None:
                raise ValueError("a file without a name")
            first = next(group)
            if folder is None:
                folder = f"{base}/part={first['part']}"
                fs.create_dir(folder)
            with fs.open_output_stream(f"{folder}/{prefix}{quote(key, safe='')}{suffix}") as out:
                for row in chain([first], group):
                    out.write(f"{row['value'] or ''}\n".encode())

    fs, base = FileSystem.from_uri(path)
    if fs.get_file_info(base).type != FileType.NotFound:
        raise FileExistsError(path)
    fs.create_dir(base)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    rows = rows.repartition(df.count() // FILES + 1, "name").sortWithinPartitions("name")
    rows.withColumn("part", F.spark_partition_id()).foreachPartition(write)


def unescaped(name: Column) -> Column:
    """The value of which `write_files` made this part of a name."""
    return F.url_decode(name)


#: Rows of label maps that one task writes, some more or less by the hash.
ROWS = 1 << 19


def write_results(masks: DataFrame, path: str, folders: int = 256) -> None:
    """Label maps by image: rows with `out_name`, the image's name with .png, in a fixed number of folders by the name's hash.

    Rows are counted first and dealt to tasks by their number, a large folder to several, each of
    which sorts its own; an image stays in one file.
    """
    out = masks.withColumn("out_name", F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".png")))
    out = out.withColumn("folder", F.pmod(F.xxhash64("out_name"), F.lit(folders)).cast("int"))
    tasks = masks.count() // ROWS + 1
    piece = F.pmod(F.xxhash64("out_name", F.lit(1)), F.lit(-(-tasks // folders)))
    out.repartition(tasks, "folder", piece).sortWithinPartitions("folder", "out_name").write.mode("overwrite").partitionBy("folder").parquet(path)
