"""Pixel tables made of small tables of images: dealt to tasks, and joined without being broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from rasterlake.plans import fixtures as V
from rasterlake.plans.all_queries import QUERIES

DATA = "/root/testdata/sf0.1"
JOINED = [
    "r23_mixup", "r24_cutmix", "r25_mosaic", "r26_mix_pipeline", "r12_rotate_whole_bilinear", "r17_clahe", "j05_join_pred_gt", "r04_resize_bilinear", "r02_tile_pixels_reflect", "r05_resize_nearest",
    "r08_rescale_mask", "r10_pad", "r11_random_crop", "r12_rotate", "s10_rasterize_polygons", "r14_shift_scale_rotate", "s10_rasterize_rle",
]


def broadcast_of_pixels(plan: str) -> list[str]:
    """Broadcasts over rows that were made by exploding."""
    found, depth, head = [], None, ""
    for line in plan.splitlines():
        at = len(re.match(r"[\s:|+-]*", line).group())
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth, head = at, line
        elif depth is not None and "Generate explode" in line:
            found.append(head)
    return found


def test_images_are_dealt_to_tasks_by_their_pixels(spark):
    """1,000 images of 1,152 pixels on average, of one small file."""
    assert V.raster(spark, DATA).rdd.getNumPartitions() == 1152000 // V.PIXELS + 1
    assert V.images(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", JOINED)
def test_no_pixel_table_is_broadcast(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert broadcast_of_pixels(plan) == []


def optimised(spark, name: str) -> str:
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["r12_rotate_whole_bilinear", "r17_clahe"])
def test_no_list_is_searched_for_each_pixel(spark, name):
    assert " filter(" not in optimised(spark, name).replace("[filter(", " filter(").replace("(filter(", " filter(")


def test_photometric_draws_once_a_pixel(spark):
    """Nine draws, each of nine places with the first product."""
    assert optimised(spark, "r20_photometric").count("48271") <= 81


@pytest.mark.parametrize("name", ["t05_hard_pixels", "t06_hard_pixels"])
def test_bits_of_doubles_are_taken_in_one_step(spark, name):
    """By logarithms and powers of 2 their number needed the value many times."""
    assert "LOG2" not in optimised(spark, name).upper() and "POWER" not in optimised(spark, name).upper()


def test_bits_and_doubles_turn_into_each_other():
    import numpy as np

    from rasterlake.operators.selection import bits_of, double_of

    values = np.array([-np.inf, -1.5, -5e-324, 0.0, 5e-324, 0.1, 1e308, np.inf, np.nan])
    bits = bits_of(values)
    assert list(bits) == sorted(bits)
    np.testing.assert_array_equal([double_of(int(b)) for b in bits], values)
    assert bits_of(np.array([-0.0]))[0] == 0


def test_the_centre_of_a_mosaic_is_drawn_before_pixels_are_joined(spark):
    """Not in the condition of their join, where each pixel would draw it at each place that uses it."""
    joins = [line for line in optimised(spark, "r25_mosaic").splitlines() if " Join " in f" {line}" and "quadrant" in line]
    assert joins and not any("48271" in line for line in joins)


def test_folders_are_dealt_to_tasks_by_their_number(spark, tmp_path):
    """Each is a file that takes its time; by their few bytes they would all go to one task."""
    from rasterlake.sources.files import FOLDERS, manifest_from_dir, write_folders

    names = spark.range(2 * FOLDERS + 10).selectExpr("concat('n', id) name", "cast(id as string) value")
    path = f"file://{tmp_path}/folders"
    write_folders(names, "name", path)
    found = manifest_from_dir(spark, path, ".txt").selectExpr("regexp_extract(path, 'part=([0-9]+)/', 1) part", "regexp_extract(path, 'name=([^/]+)/[^/]*$', 1) name").collect()
    assert len({r["part"] for r in found}) == 3
    assert sorted(r["name"] for r in found) == sorted(f"n{i}" for i in range(2 * FOLDERS + 10))


def test_files_share_folders(spark, tmp_path, monkeypatch):
    """A folder a task, not a folder a file; each file has its own name, whatever letters are in it, and all its lines."""
    from rasterlake.plans import run_queries as Q
    from rasterlake.sources import files as S

    path = f"file://{tmp_path}/query"
    monkeypatch.setattr(Q, "new_path", lambda spark, name: path)
    found = QUERIES["s01_manifest_from_dir"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 50 and [r["name"] for r in found] == sorted(r["name"] for r in found)
    assert len([p for p in (tmp_path / "query").rglob("*") if p.is_dir()]) == 1

    monkeypatch.setattr(S, "FILES", 4)
    names = ["a/b", "ü %", "_c", ".d", "e+f", "", *[f"n{i}" for i in range(20)]]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names * 2)] + [("n0", None)], "name string, value int")
    S.write_files(df, "name", "value", f"{path}-2", "p-")
    listed = S.manifest_from_dir(spark, f"{path}-2", ".txt").select(S.unescaped(F.regexp_extract("file_name", r"^p-(.*)\.txt$", 1)).alias("name"), "path").collect()
    assert sorted(r["name"] for r in listed) == sorted(names)
    assert 2 < len({r["path"].rsplit("/", 1)[0] for r in listed}) <= 14
    text = spark.read.option("recursiveFileLookup", "true").text(f"{path}-2").collect()
    assert sorted(r["value"] for r in text) == sorted(["", *map(str, range(2 * len(names)))])
    assert (tmp_path / "query-2").rglob("p-n0.txt").__next__().read_text().count("\n") == 3
    S.write_files(df.where("false"), "name", "value", f"{path}-3")
    assert S.manifest_from_dir(spark, f"{path}-3", ".txt").count() == 0
    with pytest.raises(FileExistsError):
        S.write_files(df, "name", "value", f"{path}-2")
    with pytest.raises(Exception, match="a file without a name"):
        S.write_files(df.withColumn("name", F.lit(None)), "name", "value", f"{path}-4")


def test_propagation_has_tasks_by_its_values(spark):
    """Not as many as `spark.sql.shuffle.partitions`, which its few values leave nearly empty in every step."""
    from rasterlake.operators import propagation as P

    start = spark.range(2 * P.VALUES // 10 + 10).selectExpr("0L graph_id", "id node", "explode(sequence(0, 9)) class_id", "1D y")
    classes, n = P._measure(start)
    assert classes == list(range(10)) and n == 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = P.propagate(spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 1.0)], "graph_id long, src long, dst long, w double"), spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 0.0)], "graph_id long, node long, class_id int, y double"), iterations=1)
        assert out.rdd.getNumPartitions() == 1 and out.count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_small_picture_takes_no_whole_tile():
    """Sums are made of its own pixels and a rim, not of 256 x 256 places."""
    import numpy as np
    import pyarrow as pa

    from rasterlake.operators import boxes as B

    y, x = (i.ravel() for i in np.mgrid[0:30, 0:40])
    picture = pa.table({"y": y + 256, "x": x, "ty": np.ones(1200, np.int64), "tx": np.zeros(1200, np.int64), "label": y % 3})
    (labels,), top, left = B._grid(picture, ["label"], 256, 2)
    assert labels.shape == (34, 44) and (top, left) == (256, 0)
    np.testing.assert_array_equal(labels[2:-2, 2:-2], np.arange(30)[:, None] % 3 * np.ones((1, 40), np.int64))
    assert (labels[:2] == B._MISSING).all() and (labels[:, -2:] == B._MISSING).all()
    rim = picture.set_column(0, "y", pa.array(y + 226))  # the pixels of a neighbour only
    assert B._grid(rim, ["label"], 256, 2)[0][0].shape == (4, 4)


@pytest.mark.parametrize("name", ["r02_tile_pixels_reflect", "r04_resize_bilinear", "r05_resize_nearest", "r08_rescale_mask", "r10_pad"])
def test_lines_of_images_are_joined_instead_of_pixels(spark, name):
    joins = [line for line in optimised(spark, name).splitlines() if " Join " in f" {line}"]
    assert joins and all("sy#" in line and "sx#" not in line and " x#" not in line for line in joins)


@pytest.mark.parametrize("name", ["r12_rotate_whole_bilinear", "r12_rotate", "r14_shift_scale_rotate"])
def test_blocks_of_images_are_moved_to_be_warped(spark, name):
    """Pixels of the result are made after the last shuffle, in tasks by their number, and no pixel is a key of a join."""
    from rasterlake.operators import raster as R

    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange ")[0].count("Generate explode") == 2
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and all("by#" in line and "bx#" in line and "sx#" not in line for line in joins)
    n = 2068981 if name == "r12_rotate_whole_bilinear" else 1152000
    assert df.rdd.getNumPartitions() == n // R.WARPED + 1


def test_lines_keep_missing_pixels_apart_from_empty_ones(spark):
    from pyspark.sql import functions as F

    from rasterlake.operators import raster as R

    have = {(0, 1): 5, (0, 3): None, (2, 0): 7, (2, 1): 8}
    pixels = spark.createDataFrame([(1, y, x, v) for (y, x), v in have.items()], "image_id long, y long, x long, v int")
    image = spark.createDataFrame([(1, 3, 5)], "image_id long, h long, w long")
    cells = lambda df: {(r["y"], r["x"]): r["v"] for r in df.collect()}
    assert cells(R.resize_nearest(pixels, image, F.lit(3), F.lit(5), ["v"])) == have
    assert cells(R.pad(pixels, image, F.lit(3), F.lit(6), {"v": 9})) == {(y, x): have.get((y, x)) or 9 for y in range(3) for x in range(6)}
    assert cells(R.resize_bilinear(pixels, image, F.lit(3), F.lit(5), ["v"])).keys() >= have.keys()
    whole = R.resize_bilinear(pixels, image.selectExpr("image_id", "h", "2L w"), F.lit(3), F.lit(2), ["v"])
    assert cells(whole) == {(0, 0): 0.0, (0, 1): 5.0, (1, 0): 0.0, (1, 1): 0.0, (2, 0): 7.0, (2, 1): 8.0}
    with pytest.raises(Exception, match="a pixel is given twice"):
        R.pad(pixels.unionAll(pixels), image, F.lit(3), F.lit(6), {"v": 9}).collect()


def test_areas_of_few_classes_are_grouped_once(spark, monkeypatch):
    """Not by pairs of labels and by classes again; with many classes the counts are the same."""
    from rasterlake.operators import metrics as M

    plan = optimised(spark, "a01_areas_per_image")
    assert sum("Aggregate " in line for line in plan.splitlines()) == 1
    rows = [(i, (i * 7 + k * k) % 5 if k % 6 else 255, (k * 3) % 7 if k % 5 else None) for i in range(4) for k in range(30)] + [(9, 255, 1), (8, None, 1), (7, 6, 6)]
    df = spark.createDataFrame(rows, "image_id long, gt int, pred int")
    few = M.areas_per_image(df, 4)
    monkeypatch.setattr(M, "FEW_CLASSES", 0)
    many = M.areas_per_image(df, 4)
    assert few.dtypes == many.dtypes
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_prediction_and_truth_meet_by_lines(spark):
    """A row a line is moved, not a row a pixel; lines with gaps, without labels or of one side only give the pixels of both."""
    from rasterlake.operators import labels as L

    plan = QUERIES["j05_join_pred_gt"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[image_id#\d+L?, sy#\d+L?\]", plan)
    side = lambda cells: spark.createDataFrame([(1, *c) for c in cells], "image_id long, y int, x int, label int")
    pred, gt = side([(0, 0, 1), (0, 1, 2), (0, 2, None), (1, 3, 4), (2, 0, 5)]), side([(0, 0, 7), (0, 2, 8), (0, 4, 9), (1, 1, 6), (1, 3, None), (3, 0, 1)])
    met = L.join_pred_gt(pred, gt)
    assert dict(met.dtypes) == {"image_id": "bigint", "y": "int", "x": "int", "gt": "int", "pred": "int"}
    assert sorted(map(tuple, met.collect())) == [(1, 0, 0, 7, 1), (1, 0, 2, 8, None), (1, 1, 3, None, 4)]
    with pytest.raises(Exception, match="a pixel is given twice"):
        L.join_pred_gt(pred.unionAll(pred), gt).collect()


def test_results_are_dealt_to_tasks_by_their_rows(spark, tmp_path, monkeypatch):
    """Of two folders, one file each before; an image stays in one file, in order."""
    from rasterlake.sources import files as S

    monkeypatch.setattr(S, "ROWS", 100, raising=False)
    df = spark.range(2000).select(F.concat(F.lit("n"), F.col("id") % 40, F.lit(".jpg")).alias("file_name"), F.col("id").alias("label"))
    S.write_results(df, f"file://{tmp_path}/out", folders=2)
    back = spark.read.parquet(f"file://{tmp_path}/out").withColumn("file", F.input_file_name())
    per = back.groupBy("out_name").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 40 and {(r["files"], r["n"]) for r in per} == {(1, 50)}
    assert back.select("file").distinct().count() > 4
    assert sorted(r["label"] for r in back.select("label").collect()) == list(range(2000))
