"""Label algebra: remapping, ignore rules, colours, class lists and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.scalars import draw
from rasterlake.operators.raster import join_lines

IGNORE = 255
# Ids without a class among the 182 of COCO-Stuff, the highest thing id, and Cityscapes' ids of train ids 0 to 18.
STUFF_GAPS = (11, 25, 28, 29, 44, 65, 67, 68, 70, 82, 90)
STUFF_IDS, THING_IDS = 182, 90
CITYSCAPES_IDS = (7, 8, 11, 12, 13, 17, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 31, 32, 33)


def stuff_map() -> dict[int, int]:
    """COCO-Stuff ids to train ids: the classes there are, numbered without gaps; 255 stays."""
    return {old: new for new, old in enumerate(i for i in range(STUFF_IDS) if i not in STUFF_GAPS)} | {IGNORE: IGNORE}


def object_map() -> dict[int, int]:
    """COCO-Object: things from 1 on, everything above them, 255 included, background. 90 has no class and stays."""
    things = {old: new + 1 for new, old in enumerate(i for i in range(THING_IDS) if i not in STUFF_GAPS)}
    return things | {i: 0 for i in [*range(THING_IDS + 1, STUFF_IDS), IGNORE]}


def custom_map(known: list[str], wanted: list[str]) -> dict[int, int]:
    """Old to new ids of a class subset; classes left out are ignored. An unknown name is an error."""
    if missing := [c for c in wanted if c not in known]:
        raise ValueError(f"classes {missing} are not in the dataset")
    return {i: wanted.index(c) if c in wanted else IGNORE for i, c in enumerate(known)}


def remap(label: Column, mapping: dict[int, int]) -> Column:
    """All labels at once by the map; labels that it lacks are unchanged."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), label), label)


def reduce_zero_label(label: Column) -> Column:
    return F.when(label.isin(0, IGNORE), IGNORE).otherwise(label - 1)


def invalid_to_ignore(label: Column, n_classes: int, ignore: int = IGNORE) -> Column:
    return F.when((label < 0) | (label >= n_classes), ignore).otherwise(label)


def mask_ignore(df: DataFrame, ignore: int = IGNORE) -> DataFrame:
    return df.where(F.col("gt") != ignore)


def propagate_ignore(gt: Column, pred: Column, ignore: int = IGNORE) -> Column:
    return F.when(gt == ignore, ignore).otherwise(pred)


def join_pred_gt(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Prediction and ground truth of a pixel side by side, from x = 0 on; whole lines are joined, and a pixel given twice by one side is an error."""
    return join_lines(gt.withColumnRenamed("label", "gt"), pred.withColumnRenamed("label", "pred"), ["gt"], ["pred"])


def format_labels(label: Column, dataset: str) -> Column:
    """Labels as a benchmark's submissions want them."""
    if dataset == "ade":
        return label + 1
    if dataset == "cityscapes":
        return remap(label, dict(enumerate(CITYSCAPES_IDS)))
    if dataset == "loveda":
        return label
    raise ValueError(f"no submission format for {dataset}")


def bit_palette(n: int) -> list[tuple[int, int, int]]:
    """The palette whose colours spread an index's bits over the channels, highest bit first."""
    return [tuple(sum(((i >> (3 * k + c)) & 1) << (7 - k) for k in range(8)) for c in range(3)) for i in range(n)]


def random_palette(n: int, seed: int = 0) -> list[tuple[int, int, int]]:
    """A colour per class from the portable draw."""

    def one(key: int) -> int:
        h1 = (key * 48271 + seed * 16807 + 12345) % 2147483647
        h2 = ((h1 * h1 % 2147483647) * 69621 + h1) % 2147483647
        return ((h2 * h2 % 2147483647) * 16807 + h2) % 2147483647 % 256

    return [(one(3 * i), one(3 * i + 1), one(3 * i + 2)) for i in range(n)]


def class_def(spark: SparkSession, names: list[str], palette: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, n, *c) for i, (n, c) in enumerate(zip(names, palette, strict=True))], "class_id int, name string, r int, g int, b int")


def custom_palette(classes: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Colours of the classes that stay, by new id."""
    return classes.withColumn("new_id", remap(F.col("class_id"), mapping)).where(F.col("new_id") != IGNORE).select("new_id", "r", "g", "b").orderBy("new_id")


def _channel(label: Column, palette: list[tuple[int, int, int]], i: int, wrap: bool) -> Column:
    values = F.array(*[F.lit(c[i]) for c in palette])
    if wrap:
        return F.element_at(values, (F.pmod(label, F.lit(len(palette))) + 1).cast("int"))
    return F.when(label.between(0, len(palette) - 1), F.try_element_at(values, (label + 1).cast("int"))).otherwise(0)


def colorize(df: DataFrame, palette: list[tuple[int, int, int]], label: str = "label", wrap: bool = True) -> DataFrame:
    """RGB of labels: the palette repeats, or labels beyond it are black. Palettes are literals, so nothing is joined."""
    return df.withColumns({c: _channel(F.col(label), palette, i, wrap) for i, c in enumerate(("cr", "cg", "cb"))})


def overlay(df: DataFrame, palette: list[tuple[int, int, int]], alpha: float = 0.4, label: str = "label", skip: tuple[int, ...] = (0, IGNORE), rounding: str = "trunc", wrap: bool = False) -> DataFrame:
    """Image and class colour blended; labels in `skip` keep the image.

    `rounding` is trunc, round (which saturates), or rgba: an opacity of 8 bits, cut off, is laid over the image, rounded half up.
    """
    df = colorize(df, palette, label, wrap)

    def blend(v: str, c: str) -> Column:
        a = int(alpha * 255)
        mixed = F.col(v) * (1 - alpha) + F.col(c) * alpha if rounding != "rgba" else (F.col(v) * (255 - a) + F.col(c) * a) / 255 + 0.5
        out = F.bround(mixed) if rounding == "round" else F.floor(mixed)
        return F.when(F.col(label).isin(*skip), F.col(v)).otherwise(F.least(F.lit(255), out.cast("int"))) if skip else F.least(F.lit(255), out.cast("int"))

    return df.withColumns({"out_" + v: blend(v, "c" + v) for v in "rgb"}).drop("cr", "cg", "cb")


def palette_inverse(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Class ids of colours; a colour that two classes share is an error, an unknown one NULL."""
    if len(set(palette)) < len(palette):
        raise ValueError("two classes have one colour")
    codes = F.create_map(*[F.lit(x) for i, (r, g, b) in enumerate(palette) for x in (r * 65536 + g * 256 + b, i)])
    return pixels.withColumn("label", F.element_at(codes, F.col("r") * 65536 + F.col("g") * 256 + F.col("b")))


def class_coverage(train: DataFrame, val: DataFrame) -> DataFrame:
    """Positions at which two class lists (class_id, name) differ; none if they are equal and ordered alike."""
    t, v = train.select("class_id", F.col("name").alias("train_name")), val.select("class_id", F.col("name").alias("val_name"))
    return t.join(v, "class_id", "full").where(~F.col("train_name").eqNullSafe(F.col("val_name")))


def class_subset_missing(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Requested names that are not known."""
    return wanted.select("name").exceptAll(known.select("name"))


def expand_synonyms(classes: DataFrame) -> DataFrame:
    """A row per synonym (`;` separates them), with its class."""
    return classes.select("class_id", F.posexplode(F.split("name", ";")).alias("synonym_id", "synonym"))


def expand_prompts(synonyms: DataFrame, templates: list[str]) -> DataFrame:
    """Every template filled with every synonym. Templates are a literal array: no join."""
    rows = synonyms.select("*", F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("template_id", "template"))
    return rows.select(*synonyms.columns, "template_id", F.replace("template", F.lit("{}"), "synonym").alias("prompt"))


def prefix_keys(df: DataFrame, prefix: str | Column, sep: str = ".", key: str = "key") -> DataFrame:
    return df.withColumn(key, F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit(sep), F.col(key)))


def review_order(key: Column, seed: int = 0) -> Column:
    return draw(key, seed)
