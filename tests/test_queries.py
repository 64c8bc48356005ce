"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from rasterlake.plans.all_queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind; the driver compares all of them.
CHECKED = [
    "a01_areas_per_image", "a03_mean_iou", "a05_fscore", "a07_dataset_evaluate", "a09_metrics_from_confusion", "a10_group_collapsed", "a13_boundary_areas", "a16_topk_accuracy", "a17_cross_entropy", "w06_lovasz_softmax",
    "g05_normalize_graph", "g08_label_propagation_grouped", "j10_knn_join", "j03_resolve_by_priority", "r02_tile_pixels_reflect", "r04_resize_bilinear", "r11_random_crop", "r23_mixup", "s10_rasterize_rle", "s10_rasterize_coco", "g07_pixel_grid_edges", "r24_cutmix", "r25_mosaic", "r26_mix_pipeline", "s01_manifest_from_dir", "u03_shard_for_workers", "w03_exact_split", "st2_progressive_eval", "w06_lovasz_softmax_corpus", "w07_lovasz_hinge_corpus", "t05_hard_pixels", "t06_hard_pixels", "s05_class_definitions", "j10_knn_join_pruned", "w05_boundary_mask",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cells(rows, names):
    def plain(v):
        if v is None or v != v:
            return "-"
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = cells(df.collect(), df.columns)
    assert got and got == cells(found.fetchall(), names)


def test_every_query_without_sql_is_known():
    plain = {"f06_hsv_round_trip", "f11_run_name", "r17_clahe", "r20_photometric", "r21_hue_sat_value", "s13_write_summary"}
    assert set(QUERIES) - set(SQL) == plain
