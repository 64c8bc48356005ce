"""Queries of manifests, splits, run logs, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import labels as L
from rasterlake.operators import manifest as N
from rasterlake.operators import metrics as M
from rasterlake.operators import raster as R
from rasterlake.operators import runs as T
from rasterlake.plans import fixtures as V
from rasterlake.plans.fixtures import duck, duck_draw
from rasterlake.plans.registry import query, rounded
from rasterlake.sources import files as S
from rasterlake.sources import profiles as P
from rasterlake.sources.scratch import new_path
from rasterlake.streaming import incremental as I

IMAGES = (".jpg", ".png")
OK = "lower(regexp_extract(file_name, '(\\.[^.]*)$', 1)) in ('.jpg', '.png')"


def listing(spark, sf):
    return V.files(spark, sf).withColumn("stem", N.stem(F.col("file_name")))


def image_files(spark, sf):
    return listing(spark, sf).where(N.has_extension(F.col("file_name"), IMAGES))


def masks(spark, sf):
    """A mask for two images of three."""
    return image_files(spark, sf).where("page_id % 3 <> 0").select("stem", F.concat("stem", F.lit("_mask.png")).alias("file_name"))


STEM = "regexp_replace(file_name, '(.)\\.[^.]*$', '\\1')"
query("l06_filter_by_extension", duck("v_file", f"select file_name, page_id from v_file where {OK}"))(lambda s, d: V.files(s, d).where(N.has_extension(F.col("file_name"), IMAGES)))
query("l07_filter_without_trainids", duck("v_file", "select n from (select page_id, case when page_id % 4 = 0 then replace(file_name, '.', '_labelTrainIds.') else file_name end n from v_file) where not contains(n, 'TrainIds')"))(
    lambda s, d: V.files(s, d).select(F.when(F.col("page_id") % 4 == 0, F.replace("file_name", F.lit("."), F.lit("_labelTrainIds."))).otherwise(F.col("file_name")).alias("n")).where(N.without_marker(F.col("n"))))
query("l08_validate_count", "select count(*) n from pages")(lambda s, d: N.validate_count(V.table(s, d, "pages"), V.table(s, d, "pages").count()))
query("l09_clean_mask_names", duck("v_file", "select page_id, regexp_replace(file_name, '^[^-]*-', '') n from v_file"))(lambda s, d: V.files(s, d).select("page_id", N.clean_mask_name(F.col("file_name")).alias("n")))
query("l10_collect_fields", duck("v_raster", "select image_id, r, gt, {'y': y, 'x': x}.y y, {'y': y, 'x': x}.x x from v_raster"))(lambda s, d: V.raster(s, d).select("image_id", "r", "gt", F.struct("y", "x").alias("meta")).select("image_id", "r", "gt", "meta.y", "meta.x"))


def classes(spark, sf, extra: str = ""):
    """A class per label of the vectors, named by it."""
    c = V.patches(spark, sf).select(F.col("gt").alias("class_id")).distinct()
    return c.select("class_id", F.concat(F.lit("k"), "class_id", F.when(F.col("class_id") % 3 == 0, F.lit(extra)).otherwise("")).alias("name"))


query("l11_validate_class_coverage", duck("v_patch", "select distinct gt class_id, concat('k', gt) train_name, concat('k', gt, 'b') val_name from v_patch where gt % 3 = 0"))(lambda s, d: L.class_coverage(classes(s, d), classes(s, d, "b")))
query("u06_class_subset_check", duck("v_patch", "select distinct concat('k', gt, 'b') as name from v_patch where gt % 3 = 0"))(lambda s, d: L.class_subset_missing(classes(s, d, "b"), classes(s, d)))
query("l14_expand_synonyms", "select doc_id class_id, cast(i - 1 as int) synonym_id, string_split(n, ';')[i] synonym from (select doc_id, n, unnest(range(1, len(string_split(n, ';')) + 1)) i from (select doc_id, concat(lang, ';', source, ';', lang) n from documents))")(
    lambda s, d: L.expand_synonyms(V.table(s, d, "documents").select(F.col("doc_id").alias("class_id"), F.concat_ws(";", "lang", "source", "lang").alias("name"))))
TEMPLATES = ["a photo of a {}.", "a drawing of the {}.", "one {}."]
query("l15_expand_prompts", "select doc_id class_id, t.i template_id, replace(t.t, '{}', source) prompt from documents, (values (0, 'a photo of a {}.'), (1, 'a drawing of the {}.'), (2, 'one {}.')) t(i, t)")(
    lambda s, d: L.expand_prompts(V.table(s, d, "documents").select(F.col("doc_id").alias("class_id"), F.col("source").alias("synonym")), TEMPLATES).select("class_id", "template_id", "prompt"))
query("l17_custom_palette", duck("v_patch", "select new_id, r, g, b from (select case gt when 2 then 0 when 5 then 1 when 7 then 2 else 255 end new_id, gt * 10 r, gt * 20 g, gt + 1 b from (select distinct gt from v_patch)) where new_id <> 255"))(
    lambda s, d: L.custom_palette(classes(s, d).select("class_id", (F.col("class_id") * 10).alias("r"), (F.col("class_id") * 20).alias("g"), (F.col("class_id") + 1).alias("b")), {i: {2: 0, 5: 1, 7: 2}.get(i, 255) for i in range(10)}))
query("l18_prefix_keys", duck("v_step", "select concat(epoch % 3, '_', run_id) as key, round(avg(loss), 4) as value from v_step group by 1"))(
    lambda s, d: rounded(L.prefix_keys(V.steps(s, d).select(F.col("run_id").alias("key"), "epoch", "loss"), (F.col("epoch") % 3).cast("string"), "_").groupBy("key").agg(F.avg("loss").alias("value")), 4))

query("j01_pair_images_masks", duck("v_file", f"select file_name, concat({STEM}, '_mask.png') mask_name from v_file where {OK} and page_id % 3 <> 0"))(lambda s, d: N.pair_images_masks(image_files(s, d), masks(s, d)).select("file_name", "mask_name"))
query("j06_unpaired", duck("v_file", f"select file_name from v_file where {OK} and page_id % 3 = 0"))(lambda s, d: N.unpaired(image_files(s, d), masks(s, d)).select("file_name"))
query("j02_pair_with_mapping", duck("v_file", "select file_name, case when page_id % 6 = 0 then concat('/abs/', page_id) when page_id % 2 = 0 then concat('masks/m', page_id) else concat('masks/', file_name) end mask_path from v_file"))(
    lambda s, d: N.pair_with_mapping(V.files(s, d).select("file_name"), V.files(s, d).where("page_id % 2 = 0").select(F.col("file_name").alias("image_name"), F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("/abs/"), "page_id")).otherwise(F.concat(F.lit("m"), "page_id")).alias("mask_name")), "masks"))


def wanted_names(spark, sf):
    p = F.col("page_id")
    n = F.when(p % 3 == 0, F.col("file_name")).when(p % 3 == 1, N.clean_mask_name(F.col("file_name"))).otherwise(F.expr("right(file_name, length(file_name) - 7)"))
    return V.files(spark, sf).select(n.alias("name")).distinct()


query("j03_resolve_by_priority", duck("v_file", """select name, file_name, priority from (select *, row_number() over (partition by name order by priority, file_name) rk from
  (select name, file_name, 1 priority from wn join v_file on name = file_name union all select name, file_name, 2 from wn join v_file on name = regexp_replace(file_name, '^[^-]*-', '') union all select name, file_name, 3 from wn join v_file on ends_with(file_name, name))) where rk = 1""",
    wn="select distinct case when page_id % 3 = 0 then file_name when page_id % 3 = 1 then regexp_replace(file_name, '^[^-]*-', '') else right(file_name, length(file_name) - 7) end as name from v_file"))(lambda s, d: N.resolve_by_priority(wanted_names(s, d), V.files(s, d)))
query("j07_size_check", duck("v_image", "select image_id, h, w, image_id % 5 = 0 mismatch from v_image"))(lambda s, d: N.size_check(V.images(s, d).withColumn("h", F.when(F.col("image_id") % 5 == 0, F.col("h") + 1).otherwise(F.col("h"))), V.images(s, d)))
SHUF = f"select page_id, file_name, row_number() over (order by {duck_draw('page_id', 7)}, page_id) - 1 idx from v_file"
query("w03_exact_split", duck("v_file", "select page_id, case when idx < floor(n * 0.8) then 'train' when idx < floor(n * 0.8) + floor(n * 0.05) then 'val' else 'test' end split from sh, (select count(*) n from sh)", sh=SHUF))(lambda s, d: N.exact_split(V.files(s, d), "page_id", 0.8, 0.05, 0.15, 7).select("page_id", "split"))
query("t09_sample_for_review", duck("v_file", "select page_id from sh where idx < 20", sh=SHUF))(lambda s, d: V.files(s, d).orderBy(L.review_order(F.col("page_id"), 7), "page_id").limit(20).select("page_id"))
query("t10_sorted_manifest", duck("v_file", "select file_name, row_number() over (order by file_name) - 1 idx from v_file"))(lambda s, d: N.dense_index(V.files(s, d).select("file_name"), [F.col("file_name")]))
query("u01_concat_datasets", duck("v_file", "select page_id, ds dataset_idx, row_number() over (partition by ds order by page_id) - 1 sample_idx, row_number() over (order by ds, page_id) - 1 idx from (select page_id, case when page_id % 3 = 0 then 1 else 0 end ds from v_file)"))(
    lambda s, d: N.concat_datasets([V.files(s, d).select("page_id").where("page_id % 3 <> 0"), V.files(s, d).select("page_id").where("page_id % 3 = 0")], "page_id"))
query("u02_repeat_dataset", duck("v_file", "select page_id, unnest(range(3))::int copy from v_file"))(lambda s, d: N.repeat_dataset(V.files(s, d).select("page_id"), 3))
SHARD = "select page_id, slot, slot % 7 rank from (select page_id, unnest(case when idx < (7 - n % 7) % 7 then [idx, idx + n] else [idx] end) slot from sh, (select count(*) n from sh))"


def sharded(spark, sf):
    f = N.shuffled_index(V.files(spark, sf), "page_id", 7)
    return N.shard(f, V.files(spark, sf).count(), 7)


query("u03_shard_for_workers", duck("v_file", SHARD, sh=SHUF))(lambda s, d: sharded(s, d).select("page_id", "slot", "rank"))
query("u04_dedupe_padded_results", duck("v_file", "select page_id, idx slot from sh", sh=SHUF))(lambda s, d: N.drop_padding(sharded(s, d), V.files(s, d).count()).select("page_id", "slot"))
query("u08_augment_fanout", duck("v_file", "select page_id, unnest(range(4))::int copy from v_file"))(lambda s, d: N.repeat_dataset(V.files(s, d).select("page_id"), 4))
query("s17_triplet_naming", duck("v_file", "select page_id, concat(file_name, case when page_id % 2 = 0 then concat('_tile', page_id % 5) else '' end, '_aug', page_id % 4) n from v_file"))(
    lambda s, d: V.files(s, d).select("page_id", N.triplet_name(F.col("file_name"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 5), "aug", F.col("page_id") % 4).alias("n")))
query("t03_latest_checkpoint", "select folder, file_name from (select *, row_number() over (partition by folder order by n desc, file_name desc) rk from (select page_id % 20 folder, page_id n, concat('epoch_', page_id, '.pth') file_name from pages)) where rk = 1")(
    lambda s, d: N.latest_checkpoint(V.table(s, d, "pages").select((F.col("page_id") % 20).alias("folder"), F.concat(F.lit("epoch_"), "page_id", F.lit(".pth")).alias("file_name"))))
query("f01_string_functions", duck("v_file", f"select page_id, {STEM} stem, string_split(file_name, '-')[1] head, string_split(file_name, '.')[1] first, replace(file_name, '.png', '_gtFine.png') mask from v_file"))(
    lambda s, d: V.files(s, d).select("page_id", N.stem(F.col("file_name")).alias("stem"), F.substring_index("file_name", "-", 1).alias("head"), F.substring_index("file_name", ".", 1).alias("first"), N.mask_name(F.col("file_name"), ".png", "_gtFine.png").alias("mask")))
query("s03_manifest_tagged_mask", duck("v_file", "select file_name, concat(replace(file_name, '.png', ''), '_instance_color_RGB.png') mask_name from v_file where ends_with(file_name, '.png')"))(
    lambda s, d: V.files(s, d).where(F.endswith("file_name", F.lit(".png"))).select("file_name", N.tagged_mask_name(F.col("file_name"), ".png", ".png").alias("mask_name")))


@query("s04_dataset_profiles", "select doc_id, p.img_suffix, p.seg_suffix, p.z reduce_zero_label from (select doc_id, ['ade', 'cityscapes', 'stare'][n_chars % 3 + 1] ds from documents) d join (values ('ade', '.jpg', '.png', true), ('cityscapes', '_leftImg8bit.png', '_gtFine_labelTrainIds.png', false), ('stare', '.png', '.ah.png', false)) p(dataset, img_suffix, seg_suffix, z) on p.dataset = d.ds")
def dataset_profiles(spark, sf):
    named = V.table(spark, sf, "documents").select("doc_id", F.element_at(F.array(F.lit("ade"), F.lit("cityscapes"), F.lit("stare")), (F.col("n_chars") % 3 + 1).cast("int")).alias("dataset"))
    return named.join(F.broadcast(P.profiles(spark)), "dataset").select("doc_id", "img_suffix", "seg_suffix", "reduce_zero_label")  # 19 rows


query("s05_class_registry", "select doc_id, ['ade', 'voc', 'cocostuff'][n_chars % 3 + 1] dataset from documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", P.canonical(F.element_at(F.array(F.lit("ade20k"), F.lit("voc12aug"), F.lit("coco-stuff")), (F.col("n_chars") % 3 + 1).cast("int"))).alias("dataset")))

@query("s05_class_definitions", """select doc_id, name, r, g, b from (select doc_id, ['potsdam', 'stare', 'voc'][n_chars % 3 + 1] ds, n_chars % 2 c from documents) d
  join (values ('potsdam', 0, 'impervious_surface', 255, 255, 255), ('potsdam', 1, 'building', 0, 0, 255), ('stare', 0, 'background', 120, 120, 120), ('stare', 1, 'vessel', 6, 230, 230), ('voc', 0, 'background', 0, 0, 0), ('voc', 1, 'aeroplane', 128, 0, 0)) v(ds, c, name, r, g, b) on v.ds = d.ds and v.c = d.c""")
def class_definitions(spark, sf):
    """Names and colours of classes by aliases of datasets."""
    alias = F.element_at(F.array(F.lit("potsdam"), F.lit("STARE"), F.lit("voc12aug")), (F.col("n_chars") % 3 + 1).cast("int"))
    return P.with_class(V.table(spark, sf, "documents").select("doc_id", "n_chars"), alias, F.col("n_chars") % 2, P.class_defs(spark)).select("doc_id", "name", "r", "g", "b")


query("w01_moving_avg_100", duck("v_step", "select run_id, epoch, step, round(avg(loss) over (partition by run_id, epoch order by step rows between 99 preceding and current row), 9) loss_mean from v_step"))(lambda s, d: rounded(T.moving_mean(V.steps(s, d)).select("run_id", "epoch", "step", "loss_mean"), 9))


def epochs(spark, sf):
    return T.epoch_loss(V.steps(spark, sf).withColumn("batch", 1 + F.col("step") % 4))


EPOCH = {"ep": "select run_id, epoch, sum(loss * (1 + step % 4)) / sum(1 + step % 4) loss from v_step group by all"}
query("a23_epoch_loss", duck("v_step", "select run_id, epoch, round(loss, 4) loss from ep", **EPOCH))(lambda s, d: rounded(epochs(s, d), 4))
query("w09_metric_delta", duck("v_step", "select run_id, epoch, round(loss - lag(loss) over (partition by run_id order by epoch), 4) delta from ep", **EPOCH))(lambda s, d: rounded(T.metric_delta(epochs(s, d)).select("run_id", "epoch", "delta"), 4))
query("t02_best_3_checkpoints", duck("v_step", "select run_id, epoch, row_number() over (partition by run_id order by round(loss, 8), epoch) <= 3 kept from ep", **EPOCH))(lambda s, d: T.best_checkpoints(rounded(epochs(s, d), 8)).select("run_id", "epoch", "kept"))
query("t04_best_epoch", duck("v_step", "select run_id, epoch, round(loss, 4) loss from (select *, row_number() over (partition by run_id order by round(loss, 8) desc, epoch) rk from ep) where rk = 1", **EPOCH))(lambda s, d: rounded(T.best_epoch(rounded(epochs(s, d), 8), "loss"), 4))
query("a22_loss_totals", duck("v_step", "select name, round(v, 4) as value from m union all select 'loss', round(sum(v), 4) from m where contains(name, 'loss')", m="select concat(case when epoch % 2 = 0 then 'loss_' else 'acc_' end, run_id) as name, avg(v) v from (select run_id, epoch % 2 epoch, step, sum(loss) v from v_step group by all) group by 1"))(
    lambda s, d: rounded(T.loss_totals(V.steps(s, d).select(F.concat(F.when(F.col("epoch") % 2 == 0, "loss_").otherwise("acc_"), "run_id").alias("name"), "step", F.col("loss").alias("value"))), 4))
query("j11_compare_runs", duck("v_step", "select epoch, round(a.loss, 4) base_loss, round(b.loss, 4) tuned_loss, round(b.loss - a.loss, 4) delta_loss from (select * from ep where run_id = 'click') a full join (select * from ep where run_id = 'error' and epoch % 7 > 2) b using (epoch)", **EPOCH))(
    lambda s, d: rounded(T.compare_runs(epochs(s, d).where("run_id = 'click'"), epochs(s, d).where("run_id = 'error' and epoch % 7 > 2"), ["epoch"], ["loss"]), 4))
query("f09_json_extract", "select event_id, cast(props::json->>'k' as bigint) k from events")(lambda s, d: V.table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")))
query("f11_run_name")(lambda s, d: V.steps(s, d).select("run_id").distinct().withColumn("named", T.run_name("run")))


def log_rows(spark, sf):
    """A log of every epoch with nested metrics by run."""
    e = rounded(epochs(spark, sf), 4)
    value = lambda f: F.struct((F.col("loss") * f).alias("iou"), F.col("loss").alias("f1"), F.lit(0.5).alias("accuracy"))
    per = e.groupBy("epoch").agg(F.avg("loss").alias("train_loss"), F.max("loss").alias("val_loss"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("run_id", value(0.01))))).alias("m"))
    return per.select("epoch", "train_loss", "val_loss", F.struct(F.lit(0.5).alias("mIoU"), F.lit(0.5).alias("mF1"), F.lit(0.5).alias("mAcc"), F.col("m").alias("class_metrics"), F.col("m").alias("group_metrics")).alias("metrics"))


@query("s11_read_metrics_log", duck("v_step", "select epoch, run_id as name, round(round(loss, 4) * 0.01::double, 6) iou, round(loss, 4) f1 from ep", **EPOCH))
def metrics_log(spark, sf):
    """Written as JSON lines, read back, flattened to series."""
    path = new_path(spark, "log")
    S.write_metrics_log(log_rows(spark, sf), path)
    return rounded(T.class_series(S.read_metrics_log(spark, path)).select("epoch", "name", "iou", "f1"))


@query("s12_write_metrics_log", duck("v_step", "select epoch, round(avg(round(loss, 4)), 4) train_loss from ep group by epoch", **EPOCH))
def write_log(spark, sf):
    path = new_path(spark, "log")
    S.write_metrics_log(log_rows(spark, sf), path)
    return rounded(S.read_metrics_log(spark, path).select("epoch", "train_loss"), 4)


@query("s13_write_summary")
def summary(spark, sf):
    e = rounded(epochs(spark, sf), 4).withColumnRenamed("loss", "value")
    return T.summary_json(e.where("run_id = 'click'").select(F.concat(F.lit("e"), "epoch").alias("name"), "value"), e.where("run_id = 'error'").select(F.concat(F.lit("e"), "epoch").alias("name"), "value"))


@query("s14_write_partitioned_split", duck("v_file", "select case when idx < floor(n * 0.8) then 'train' when idx < floor(n * 0.8) + floor(n * 0.05) then 'val' else 'test' end split, count(*) n from sh, (select count(*) n from sh) group by 1", sh=SHUF))
def partitioned_split(spark, sf):
    path = new_path(spark, "split")
    S.write_split(N.exact_split(V.files(spark, sf), "page_id", 0.8, 0.05, 0.15, 7), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s15_write_split_lists", duck("v_file", "select case when page_id % 4 = 0 then 'val' else 'train' end split, file_name as value from v_file"))
def split_lists(spark, sf):
    path = new_path(spark, "lists")
    S.write_split_lists(V.files(spark, sf).select(F.when(F.col("page_id") % 4 == 0, "val").otherwise("train").alias("split"), F.concat("file_name", F.lit("_gtFine_polygons.json")).alias("file_name")), path)
    return spark.read.text(path).select("split", "value")


@query("s02_manifest_from_split", duck("v_file", "select concat(trim(file_name), '.jpg') file_name, concat(trim(file_name), '.png') mask_name from v_file"))
def manifest_from_split(spark, sf):
    path = new_path(spark, "stems")
    V.files(spark, sf).select(F.concat(F.lit(" "), "file_name").alias("value")).write.text(path)
    return S.manifest_from_split(spark, path, ".jpg", ".png")


@query("s01_manifest_from_dir", duck("v_file", "select distinct file_name as name, 'part' as kind, true as has_mask from v_file"))
def manifest_from_dir(spark, sf):
    """Every file below a folder; each was written under its own name, many in a folder."""
    path = new_path(spark, "folder")
    S.write_files(V.files(spark, sf), "file_name", "page_id", path, "part-")
    found = S.manifest_from_dir(spark, path, ".txt", "_mask.png")
    name = S.unescaped(F.regexp_extract("file_name", r"^part-(.*)\.txt$", 1))
    return found.select(name.alias("name"), F.substring("file_name", 1, 4).alias("kind"), (F.col("mask_name") == F.regexp_replace("file_name", r"\.txt$", "_mask.png")).alias("has_mask"))


def coco_documents(spark, sf):
    """A document for each 20 pages, written as JSON and read back: an image a page, a polygon and run lengths each."""
    path = new_path(spark, "coco")
    p = V.table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 20).alias("doc"))
    cats = F.array(*[F.struct(F.lit(10 + i).alias("id"), F.lit(f"k{i} ").alias("name")) for i in range(3)])
    wide = (F.col("page_id") % 3 + 4).cast("string")
    polygon = F.concat(F.lit("[[1,1,"), wide, F.lit(",1,"), wide, F.lit(",4,1,4],[0,0,1,1]]"))
    runs = F.concat(F.lit('{"size":[8,10],"counts":[17,'), (F.col("page_id") % 5 + 6).cast("string"), F.lit(",0,0]}"))
    one = lambda a, text: F.struct((F.col("page_id") * 2 + a).alias("id"), F.col("page_id").alias("image_id"), ((F.col("page_id") + a) % 3 + 10).alias("category_id"), text.alias("segmentation"))
    anns = F.flatten(F.collect_list(F.array(one(0, polygon), one(1, runs))))
    image = F.struct(F.col("page_id").alias("id"), F.lit("f.png").alias("file_name"), F.lit(10).alias("width"), F.lit(8).alias("height"))
    p.groupBy("doc").agg(F.collect_list(image).alias("images"), anns.alias("annotations")).withColumn("categories", cats).drop("doc").write.json(path)
    doc = spark.read.schema(S.COCO).json(path)
    annotations = S.map_categories(doc.select(F.inline("annotations")), doc.select(F.inline("categories")), {"k0": 1, "k1": 2, "k2": 3})
    return doc.select(F.inline("images")), annotations


@query("s09_read_coco", "select page_id image_id, ann, (page_id + ann) % 3 + 1 as label from (select page_id, unnest(range(2)) ann from pages)")
def coco(spark, sf):
    _, annotations = coco_documents(spark, sf)
    return annotations.select("image_id", (F.col("id") % 2).alias("ann"), F.col("label").cast("long").alias("label"))


@query("s10_rasterize_coco", """select page_id image_id, y, x, cast(case when x * 8 + y >= 17 and x * 8 + y < 17 + page_id % 5 + 6 then (page_id + 1) % 3 + 1 when y between 1 and 4 and x between 1 and page_id % 3 + 4 then page_id % 3 + 1 else 0 end as int) as label
  from (select page_id, y, unnest(range(10)) x from (select page_id, unnest(range(8)) y from pages))""")
def rasterize_coco(spark, sf):
    """Documents' polygons and run lengths, painted in their order."""
    images, annotations = coco_documents(spark, sf)
    cells = S.annotation_pixels(annotations, images)
    grid = V.grid(images.select(F.col("id").alias("image_id"), F.col("height").cast("long").alias("h"), F.col("width").cast("long").alias("w")))
    return S.paint(cells, grid)


@query("s16_write_results", duck("v_raster", "select concat('i', image_id, '.png') out_name, gt + 1 as label, count(*) n from v_raster group by all"))
def write_results(spark, sf):
    """Label maps for a submission, written and read back."""
    path = new_path(spark, "results")
    S.write_results(V.raster(spark, sf).select(F.concat(F.lit("i"), "image_id", F.lit(".jpg")).alias("file_name"), "y", "x", (F.col("gt") + 1).alias("label")), path)
    return spark.read.parquet(path).groupBy("out_name", "label").agg(F.count(F.lit(1)).alias("n"))


def boxes(spark, sf):
    """An annotation per third of an image: run lengths of full columns."""
    ims = V.images(spark, sf)
    a = ims.withColumn("ann_id", F.explode(F.array(F.lit(0), F.lit(1))))
    return a.withColumn("label", (F.col("ann_id") + 1).cast("int")).withColumn("counts", F.array(F.col("h") * (2 + 3 * F.col("ann_id")) + 1, F.col("h") * 6))


query("s10_rasterize_rle", duck("v_image", "select i.image_id, y, x, case when x * h + y >= h * 5 + 1 and x * h + y < h * 11 + 1 then 2 when x * h + y >= h * 2 + 1 and x * h + y < h * 8 + 1 then 1 else 0 end as label from (select *, unnest(range(w)) x from (select *, unnest(range(h)) y from v_image)) i"))(lambda s, d: S.paint(S.rle_pixels(boxes(s, d)), V.grid(V.images(s, d))))
query("w08_run_length_starts", duck("v_image", "select image_id, ann ann_id, h * (2 + 3 * ann) + 1 first from v_image, (values (0), (1)) t(ann)"))(lambda s, d: S.rle_pixels(boxes(s, d)).join(V.images(s, d), "image_id").groupBy("image_id", "ann_id").agg(F.min(F.col("x") * F.col("h") + F.col("y")).alias("first")))


@query("s10_rasterize_polygons", duck("v_image", "select image_id, y, x, case when y >= 2 and y <= 12 and x >= 3 and x <= 20 then 1 else 0 end as label from (select *, unnest(range(w)) x from (select *, unnest(range(h)) y from v_image))"))
def polygons(spark, sf):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    p = V.images(spark, sf).withColumn("ann_id", F.lit(0)).withColumn("label", F.lit(1)).withColumn("points", F.array(corner(3, 2), corner(20, 2), corner(20, 12), corner(3, 12)))
    return S.paint(S.polygon_pixels(p), V.grid(V.images(spark, sf)))


@query("s07_load_mask", duck("v_raster", "select image_id, case when gt in (0, 255) then 255 else case gt when 1 then 4 else gt end - 1 end as label, count(*) n from v_raster group by all"))
def load_mask(spark, sf):
    """Packed masks, decoded, remapped, zero label reduced."""
    packed = R.pack(V.raster(spark, sf).withColumnRenamed("gt", "label"))
    rows = R.unpack(packed).withColumn("label", L.reduce_zero_label(L.remap(F.col("label"), {1: 4})))
    return rows.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))


query("s06_load_image", duck("v_raster", "select image_id, cast(sum(r) as bigint) r, cast(sum(g) as bigint) g, cast(sum(b) as bigint) b from v_raster group by image_id"))(lambda s, d: R.unpack(R.pack(V.raster(s, d), ("r", "g", "b")), 3).groupBy("image_id").agg(*[F.sum(c).alias(c) for c in "rgb"]))


@query("st1_tail_metrics_log", duck("v_step", "select epoch, round(avg(round(loss, 4)), 4) train_loss from ep where epoch = (select max(epoch) from ep) group by epoch", **EPOCH))
def tail_log(spark, sf):
    path = new_path(spark, "log")
    S.write_metrics_log(log_rows(spark, sf).coalesce(1), path)
    out = I.run_available(I.tail_metrics_log(spark, path), new_path(spark, "tail"), new_path(spark, "stream"))
    return rounded(out.select("epoch", "train_loss"), 4)


@query("st2_progressive_eval", duck("v_raster", "select class_id, cast(sum(a_inter) as bigint) a_inter, cast(sum(a_union) as bigint) a_union, cast(sum(a_pred) as bigint) a_pred, cast(sum(a_gt) as bigint) a_gt from areas group by class_id", areas="select k.image_id, k.class_id, sum(case when gt = class_id and pred = class_id then 1 else 0 end) a_inter, sum(case when gt = class_id or pred = class_id then 1 else 0 end) a_union, sum(case when pred = class_id then 1 else 0 end) a_pred, sum(case when gt = class_id then 1 else 0 end) a_gt from (select image_id, unnest(range(6)) class_id from v_image) k join v_raster p on p.image_id = k.image_id where gt <> 255 group by all"))
def progressive(spark, sf):
    """Areas by image as a stream of files, some images twice; each counts once."""
    path = new_path(spark, "areas")
    areas = M.areas_per_image(V.raster(spark, sf), 6).withColumn("ts", F.timestamp_seconds(F.col("image_id") + 1700000000))
    areas.unionByName(areas.where("image_id % 3 = 0")).write.parquet(path)
    stream = spark.readStream.schema(areas.schema).parquet(path)
    return I.run_available(I.progressive_areas(stream), new_path(spark, "totals"), new_path(spark, "stream"))


