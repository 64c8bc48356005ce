"""Datasets by name: suffixes, label rules, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Image suffix, mask suffix, whether label 0 is reduced.
PROFILES = {
    "ade": (".jpg", ".png", True),
    "chase_db1": (".png", "_1stHO.png", False),
    "cityscapes": ("_leftImg8bit.png", "_gtFine_labelTrainIds.png", False),
    "coco_object": (".jpg", "_instanceTrainIds.png", False),
    "coco_stuff": (".jpg", "_labelTrainIds.png", False),
    "dark_zurich": ("_rgb_anon.png", "_gt_labelTrainIds.png", False),
    "drive": (".png", "_manual1.png", False),
    "facades": (".png", ".png", False),
    "hrf": (".png", ".png", False),
    "isaid": (".png", ".png", False),
    "isprs": (".png", ".png", True),
    "loveda": (".png", ".png", True),
    "night_driving": ("_leftImg8bit.png", "_gtCoarse_labelTrainIds.png", False),
    "pascal_context": (".jpg", ".png", False),
    "pascal_context59": (".jpg", ".png", True),
    "pascal_voc": (".jpg", ".png", False),
    "pascal_voc20": (".jpg", ".png", True),
    "potsdam": (".png", ".png", True),
    "stare": (".png", ".ah.png", False),
}
# Names that a dataset goes by.
ALIASES = {
    "cityscapes": ["cityscapes"], "ade": ["ade", "ade20k"], "voc": ["voc", "pascal_voc", "voc12", "voc12aug"], "loveda": ["loveda"], "potsdam": ["potsdam"], "vaihingen": ["vaihingen"],
    "cocostuff": ["cocostuff", "cocostuff10k", "cocostuff164k", "coco-stuff", "coco-stuff10k", "coco-stuff164k", "coco_stuff", "coco_stuff10k", "coco_stuff164k"],
    "isaid": ["isaid", "iSAID"], "stare": ["stare", "STARE"],
}
# Classes of the facades, in order, and their groups.
FACADE_CLASSES = ("BACKGROUND", "CRACK", "SPALLING", "DELAMINATION", "MISSING_ELEMENT", "WATER_STAIN", "EFFLORESCENCE", "CORROSION", "ORNAMENT_INTACT", "REPAIRS", "TEXT_OR_IMAGES")
FACADE_GROUPS = {"STRUCTURAL_DAMAGE": ("CRACK", "SPALLING", "DELAMINATION", "MISSING_ELEMENT"), "SURFACE_STAIN": ("WATER_STAIN", "EFFLORESCENCE", "CORROSION"), "HUMAN_ACTIVITY": ("TEXT_OR_IMAGES", "REPAIRS")}

# Class names by class number.
CLASSES = {
    "cityscapes": ("road", "sidewalk", "building", "wall", "fence", "pole", "traffic light", "traffic sign", "vegetation", "terrain", "sky", "person", "rider", "car", "truck", "bus", "train", "motorcycle", "bicycle"),
    "voc": ("background", "aeroplane", "bicycle", "bird", "boat", "bottle", "bus", "car", "cat", "chair", "cow", "diningtable", "dog", "horse", "motorbike", "person", "pottedplant", "sheep", "sofa", "train", "tvmonitor"),
    "loveda": ("background", "building", "road", "water", "barren", "forest", "agricultural"),
    "potsdam": ("impervious_surface", "building", "low_vegetation", "tree", "car", "clutter"),
    "vaihingen": ("impervious_surface", "building", "low_vegetation", "tree", "car", "clutter"),
    "isaid": ("background", "ship", "store_tank", "baseball_diamond", "tennis_court", "basketball_court", "Ground_Track_Field", "Bridge", "Large_Vehicle", "Small_Vehicle", "Helicopter", "Swimming_pool", "Roundabout", "Soccer_ball_field", "plane", "Harbor"),
    "stare": ("background", "vessel"),
}
# Colours (red, green, blue) by class number.
COLOURS = {
    "cityscapes": ((128, 64, 128), (244, 35, 232), (70, 70, 70), (102, 102, 156), (190, 153, 153), (153, 153, 153), (250, 170, 30), (220, 220, 0), (107, 142, 35), (152, 251, 152), (70, 130, 180), (220, 20, 60), (255, 0, 0), (0, 0, 142), (0, 0, 70), (0, 60, 100), (0, 80, 100), (0, 0, 230), (119, 11, 32)),
    "loveda": ((255, 255, 255), (255, 0, 0), (255, 255, 0), (0, 0, 255), (159, 129, 183), (0, 255, 0), (255, 195, 128)),
    "potsdam": ((255, 255, 255), (0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0)),
    "vaihingen": ((255, 255, 255), (0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0)),
    "isaid": ((0, 0, 0), (0, 0, 63), (0, 63, 63), (0, 63, 0), (0, 63, 127), (0, 63, 191), (0, 63, 255), (0, 127, 63), (0, 127, 127), (0, 0, 127), (0, 0, 191), (0, 0, 255), (0, 191, 127), (0, 127, 191), (0, 127, 255), (0, 100, 155)),
    "stare": ((120, 120, 120), (6, 230, 230)),
}


def bit_colour(i: int) -> tuple[int, int, int]:
    """The colour that a class number's bits spell: each three bits, from the lowest, are the next bit of red, green and blue, from the highest."""
    return tuple(sum(((i >> (3 * k + c)) & 1) << (7 - k) for k in range(8)) for c in range(3))


def class_defs(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """`dataset, class_id, name, r, g, b` of the datasets whose classes are known here.

    Larger class lists (those of ade and cocostuff have 150 and 171 classes) are not kept in code: `more`, a table of the
    same columns read from a file, adds them.
    """
    rows = [(d, i, name, *(COLOURS[d][i] if d in COLOURS else bit_colour(i))) for d, names in CLASSES.items() for i, name in enumerate(names)]
    known = spark.createDataFrame(rows, "dataset string, class_id int, name string, r int, g int, b int")
    return known if more is None else known.unionByName(more)


def with_class(df: DataFrame, alias: Column, class_id: Column, defs: DataFrame) -> DataFrame:
    """`df` with the class's `name`, `r`, `g`, `b` by any name of the dataset; an unknown name, or a class that the dataset lacks, is an error."""
    rows = df.withColumn("__d", canonical(alias)).withColumn("__c", class_id.cast("int"))
    named = rows.join(F.broadcast(defs.select(F.col("dataset").alias("__d"), F.col("class_id").alias("__c"), "name", "r", "g", "b")), ["__d", "__c"], "left")  # a row a class
    missing = F.raise_error(F.concat_ws(" ", F.lit("no class"), "__c", F.lit("of"), "__d")).cast("string")
    return named.withColumn("name", F.coalesce("name", missing)).drop("__d", "__c")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v, 255) for k, v in PROFILES.items()], "dataset string, img_suffix string, seg_suffix string, reduce_zero_label boolean, ignore_index int")


def canonical(alias: Column) -> Column:
    """The dataset of an alias; an unknown alias is an error when it runs."""
    names = F.create_map(*[F.lit(x) for k, v in ALIASES.items() for a in v for x in (a, k)])
    return F.coalesce(F.element_at(names, alias), F.raise_error(F.concat(F.lit("unrecognised dataset "), alias)).cast("string"))


def group_ids(classes: tuple[str, ...] = FACADE_CLASSES, groups: dict[str, tuple[str, ...]] = FACADE_GROUPS) -> dict[str, list[int]]:
    return {g: [classes.index(c) for c in names] for g, names in groups.items()}
