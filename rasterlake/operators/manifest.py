"""Manifests of images and masks: pairing, splits, shards, dataset composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.functions.scalars import draw
from rasterlake.sources.scratch import stage


def has_extension(name: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*extensions)


def without_marker(name: Column, marker: str = "TrainIds") -> Column:
    return ~F.contains(name, F.lit(marker))


def clean_mask_name(name: Column) -> Column:
    """What follows the first dash."""
    return F.regexp_replace(name, r"^[^-]*-", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def mask_name(name: Column, img_suffix: str, seg_suffix: str) -> Column:
    return F.replace(name, F.lit(img_suffix), F.lit(seg_suffix))


def tagged_mask_name(name: Column, img_suffix: str, seg_suffix: str, tag: str = "_instance_color_RGB") -> Column:
    return F.concat(F.replace(name, F.lit(img_suffix), F.lit("")), F.lit(tag + seg_suffix))


def validate_count(df: DataFrame, expected: int) -> DataFrame:
    """One row with the count; another count than expected is an error when it runs."""
    n = F.count(F.lit(1))
    return df.agg(F.when(n == expected, n).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} rows, found "), n.cast("string"))).cast("long")).alias("n"))


def pair_images_masks(images: DataFrame, masks: DataFrame, key: str = "stem", on_missing: str = "skip") -> DataFrame:
    """Images with the mask of the same key; without one they are left out, or an error."""
    masks = masks.select(F.col(key), F.col("file_name").alias("mask_name"))
    if on_missing == "skip":
        return images.join(masks, key)
    out = images.join(masks, key, "left")
    return out.withColumn("mask_name", F.coalesce("mask_name", F.raise_error(F.concat(F.lit("no mask for "), key)).cast("string")))


def unpaired(images: DataFrame, masks: DataFrame, key: str = "stem") -> DataFrame:
    return images.join(masks, key, "left_anti")


def pair_with_mapping(images: DataFrame, name_map: DataFrame, mask_dir: str) -> DataFrame:
    """Mask paths by an optional map of names; mapped absolute paths are taken as they are."""
    named = images.join(name_map.select(F.col("image_name").alias("file_name"), F.col("mask_name").alias("__m")), "file_name", "left")
    m = F.coalesce("__m", "file_name")
    return named.withColumn("mask_path", F.when(F.startswith(m, F.lit("/")), m).otherwise(F.concat(F.lit(mask_dir + "/"), m))).drop("__m")


def resolve_by_priority(wanted: DataFrame, files: DataFrame, tail: int = 8) -> DataFrame:
    """The file of each wanted name: the same name, else one whose part after the first dash is the name, else one that ends in it.

    The suffix match is an equi-join on the last `tail` characters, verified with endswith;
    names shorter than that are matched by their own length.
    """
    w = wanted.select("name")
    f = files.select("file_name")
    exact = w.join(f, F.col("name") == F.col("file_name")).withColumn("priority", F.lit(1))
    dash = w.join(f.withColumn("part", clean_mask_name(F.col("file_name"))).where(F.contains("file_name", F.lit("-"))), F.col("name") == F.col("part")).withColumn("priority", F.lit(2)).drop("part")
    sizes = F.array(*[F.lit(i) for i in range(1, tail + 1)])
    ends = f.withColumn("n", F.explode(sizes)).where(F.length("file_name") >= F.col("n")).select("file_name", F.expr("right(file_name, n)").alias("end"), "n")
    tails = w.withColumn("n", F.least(F.length("name"), F.lit(tail))).withColumn("end", F.expr("right(name, n)"))
    suffix = tails.join(ends, ["n", "end"]).where(F.endswith("file_name", F.col("name"))).select("name", "file_name").withColumn("priority", F.lit(3))
    found = exact.unionByName(dash).unionByName(suffix)
    first = found.groupBy("name").agg(F.min(F.struct("priority", "file_name")).alias("f"))
    return first.select("name", F.col("f.file_name").alias("file_name"), F.col("f.priority").alias("priority"))


def size_check(declared: DataFrame, actual: DataFrame, key: str = "image_id") -> DataFrame:
    """Sizes, the actual one where they differ, and whether they differ."""
    a = actual.select(key, F.col("h").alias("ah"), F.col("w").alias("aw"))
    return declared.join(a, key).select(key, F.col("ah").alias("h"), F.col("aw").alias("w"), ((F.col("h") != F.col("ah")) | (F.col("w") != F.col("aw"))).alias("mismatch"))


#: Classes of hashes for ranks over a whole table without one task that sorts it.
RANK_CLASSES = 4096


def dense_index(df: DataFrame, order: list[Column], bucket: Column | None = None, name: str = "idx") -> DataFrame:
    """A whole-table row index, 0 up, in `order`.

    Buckets are counted, their offsets summed in a table of one row per bucket, and only the rows of
    one bucket are sorted together. `bucket` must not decrease along the order and have a fixed
    number of values; without one, buckets are ranges of the order that Spark samples, as many as
    there are shuffle partitions, and the table is written once, so that they stay what they are.
    """
    if bucket is None:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = stage(df.repartitionByRange(n, *order).withColumn("__b", F.spark_partition_id()), "ranges")
    else:
        rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(W.Window.orderBy("__b").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    rank = F.row_number().over(W.Window.partitionBy("__b").orderBy(*order)) - 1
    return rows.withColumn("__r", rank).join(offsets, "__b").withColumn(name, F.col("__o") + F.col("__r")).drop("__b", "__o", "__r")


def shuffled_index(df: DataFrame, key: str, seed: int = 0, name: str = "idx") -> DataFrame:
    """An index in the order of a portable draw, ties by key."""
    d = draw(F.col(key), seed)
    return dense_index(df, [d, F.col(key)], F.floor(d / (2147483647 // RANK_CLASSES + 1)), name)


def exact_split(df: DataFrame, key: str, train: float, val: float, test: float, seed: int = 0) -> DataFrame:
    """A shuffled split of exact sizes: floor(n train), floor(n val), and the rest."""
    if min(train, val, test) < 0 or not 0.99 <= train + val + test <= 1.01:
        raise ValueError("split ratios must be non-negative and add up to 1")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    rows = shuffled_index(df, key, seed).join(F.broadcast(n))  # one row
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    return rows.withColumn("split", F.when(F.col("idx") < a, "train").when(F.col("idx") < a + b, "val").otherwise("test")).drop("__n", "idx")


def concat_datasets(parts: list[DataFrame], key: str) -> DataFrame:
    """All parts with dataset_idx, sample_idx within the part, and a global idx by cumulative size."""
    rows = None
    for i, part in enumerate(parts):
        part = dense_index(part, [F.col(key)], name="sample_idx").withColumn("dataset_idx", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("dataset_idx").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("dataset_idx", F.coalesce(F.sum("__n").over(W.Window.orderBy("dataset_idx").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return rows.join(F.broadcast(offsets), "dataset_idx").withColumn("idx", F.col("__o") + F.col("sample_idx")).drop("__o")


def repeat_dataset(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def shard(df: DataFrame, n: int, ranks: int, idx: str = "idx") -> DataFrame:
    """Rows by rank, padded to a multiple of `ranks` by repeating the head; `slot` is the padded index.

    A row's copies are its slots idx, idx + n, ...: no row of the table is gathered to pad.
    """
    total = -(-n // ranks) * ranks
    slots = F.filter(F.sequence(F.col(idx), F.lit(total - 1).cast("long"), F.lit(n).cast("long")), lambda s: s < total)
    return df.withColumn("slot", F.explode(slots)).withColumn("rank", F.col("slot") % ranks)


def drop_padding(sharded: DataFrame, n: int) -> DataFrame:
    return sharded.where(F.col("slot") < n)


def tta_views(df: DataFrame, scales: list[float], flips: list[bool], directions: list[str]) -> DataFrame:
    """A row per scale, flip and direction; unflipped views have one direction."""
    views = [(s, f, d) for s in scales for f in flips for d in (directions if f else directions[:1])]
    return df.withColumn("v", F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(f).alias("flip"), F.lit(d).alias("direction")) for s, f, d in views]))).select("*", "v.*").drop("v")


def partner_pairing(df: DataFrame, n: int, salt: int, idx: str = "idx", key: str = "image_id", allow_self: bool = False) -> DataFrame:
    """One drawn partner a row by an equi-join on the index: another row, unless `allow_self`; a single row is its own."""
    step = draw(F.col(key), salt)
    partner = step % n if allow_self else (F.col(idx) + 1 + step % max(n - 1, 1)) % n
    return df.withColumn("__p", partner).join(df.select(F.col(idx).alias("__p"), F.col(key).alias("partner_id")), "__p").drop("__p")


def triplet_name(base: Column, tile: Column, suffix: str, i: Column) -> Column:
    """`{base}_tile{t}_{suffix}{i}`, without the tile part where the tile is NULL."""
    return F.concat_ws("_", base, F.when(tile.isNotNull(), F.concat(F.lit("tile"), tile.cast("string"))), F.concat(F.lit(suffix), i.cast("string")))


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """`latest.*` of a folder, else the name with the largest trailing number."""
    number = F.regexp_extract("file_name", r"(\d+)\.[^.]*$", 1)
    order = F.when(F.startswith("file_name", F.lit("latest.")), F.lit(1 << 62)).otherwise(F.when(number != "", number.cast("long")).otherwise(-1))
    return files.groupBy("folder").agg(F.max_by("file_name", F.struct(order, "file_name")).alias("file_name"))
