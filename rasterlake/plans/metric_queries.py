"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import labels as L
from rasterlake.operators import losses as X
from rasterlake.operators import metrics as M
from rasterlake.plans import fixtures as V
from rasterlake.plans.fixtures import duck
from rasterlake.plans.registry import query, rounded


def areas_sql(source: str, n: int, where: str = "true") -> str:
    return f"""select k.image_id, k.class_id, cast(sum(case when gt = class_id and pred = class_id then n else 0 end) as bigint) a_inter,
      cast(sum(case when gt = class_id or pred = class_id then n else 0 end) as bigint) a_union, cast(sum(case when pred = class_id then n else 0 end) as bigint) a_pred, cast(sum(case when gt = class_id then n else 0 end) as bigint) a_gt
      from (select distinct image_id, unnest(range({n}))::int class_id from {source} where gt <> 255 and {where}) k
      join (select image_id, gt, pred, count(*) n from {source} where gt <> 255 and {where} group by all) p on k.image_id = p.image_id group by all"""


TOTALS = "select class_id, cast(sum(a_inter) as bigint) a_inter, cast(sum(a_union) as bigint) a_union, cast(sum(a_pred) as bigint) a_pred, cast(sum(a_gt) as bigint) a_gt from areas group by class_id"
CLASSES = """select class_id, a_inter::double / nullif(a_union, 0) iou, a_inter::double / nullif(a_gt, 0) acc, 2.0 * a_inter / nullif(a_pred + a_gt, 0) dice,
  a_inter::double / nullif(a_pred, 0) as precision, a_inter::double / nullif(a_gt, 0) recall from totals"""
RASTER = {"areas": areas_sql("v_raster", 6), "totals": TOTALS, "classes": CLASSES}
CONF = "select c1 gt, c2 pred, (select count(*) from {0} where gt = c1 and pred = c2) n from (select unnest(range({1}))::int c1), (select unnest(range({1}))::int c2)"
COUNTS = """select c class_id, cast(sum(case when gt = c and pred = c then n else 0 end) as bigint) tp, cast(sum(case when gt <> c and pred = c then n else 0 end) as bigint) fp,
  cast(sum(case when gt = c and pred <> c then n else 0 end) as bigint) fn from conf, (select distinct gt c from conf) group by c"""
RATES = "tp, fp, fn, round(coalesce(tp::double / nullif(tp + fp + fn, 0), 0), 6) iou, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) accuracy"


def raster_areas(spark, sf):
    return M.areas_per_image(V.raster(spark, sf), 6)


def raster_totals(spark, sf):
    return M.total_areas(raster_areas(spark, sf))


query("a01_areas_per_image", duck("v_pair", "select * from areas", areas=areas_sql("v_pair", 3)))(lambda s, d: M.areas_per_image(V.pairs(s, d), 3))
query("a02_total_areas", duck("v_raster", TOTALS, areas=RASTER["areas"]))(raster_totals)
query("a03_mean_iou", duck("v_raster", "select round((select sum(a_inter)::double / sum(a_gt) from totals), 6) a_acc, round(avg(iou), 6) m_iou, round(avg(acc), 6) m_acc from classes", **RASTER))(lambda s, d: rounded(M.mean_metrics(raster_totals(s, d)).select("a_acc", "m_iou", "m_acc")))
query("a04_mean_dice", duck("v_raster", "select round(avg(dice), 6) m_dice, round(avg(acc), 6) m_acc from classes", **RASTER))(lambda s, d: rounded(M.mean_metrics(raster_totals(s, d)).select("m_dice", "m_acc")))
query("a05_fscore", duck("v_raster", "select class_id, round(precision, 6) as precision, round(recall, 6) recall, round(5.0 * precision * recall / nullif(4.0 * precision + recall, 0), 6) fscore from classes", **RASTER))(lambda s, d: rounded(M.class_metrics(raster_totals(s, d), beta=2.0).select("class_id", "precision", "recall", "fscore")))
query("a06_nan_to_num", duck("v_doc", "select image_id % 50 key, round(coalesce(avg(case when pred = 1 then gt end), -1.0), 6) rate from v_doc group by 1"))(lambda s, d: rounded(M.nan_to_num(V.image_labels(s, d).groupBy((F.col("image_id") % 50).alias("key")).agg(F.avg(F.when(F.col("pred") == 1, F.col("gt"))).alias("rate")), -1.0)))
query("a07_dataset_evaluate", duck("v_raster", """select concat('IoU.c', class_id) as key, round_even(iou * 100, 2) / 100 as value from classes union all select concat('Acc.c', class_id), round_even(acc * 100, 2) / 100 from classes
  union all select concat('Dice.c', class_id), round_even(dice * 100, 2) / 100 from classes union all select 'aAcc', round_even((select sum(a_inter)::double / sum(a_gt) from totals) * 100, 2) / 100
  union all select 'mIoU', round_even(avg(iou) * 100, 2) / 100 from classes union all select 'mAcc', round_even(avg(acc) * 100, 2) / 100 from classes union all select 'mDice', round_even(avg(dice) * 100, 2) / 100 from classes""", **RASTER))(lambda s, d: M.dataset_evaluate(raster_totals(s, d), ["mIoU", "mDice"], {i: f"c{i}" for i in range(6)}))
query("a08_confusion_matrix", duck("v_pair", "select * from conf", conf=CONF.format("v_pair", 3)))(lambda s, d: M.confusion_matrix(V.pairs(s, d), 3))
query("a08_confusion_wide", duck("v_pair", 'select gt, cast(sum(case when pred = 0 then n end) as bigint) "0", cast(sum(case when pred = 1 then n end) as bigint) "1", cast(sum(case when pred = 2 then n end) as bigint) "2" from conf group by gt', conf=CONF.format("v_pair", 3)))(lambda s, d: M.confusion_wide(M.confusion_matrix(V.pairs(s, d), 3), 3))
query("a09_metrics_from_confusion", duck("v_raster", f"select class_id, {RATES} from counts", conf=CONF.format("v_raster", 6), counts=COUNTS))(lambda s, d: rounded(M.metrics_from_confusion(M.confusion_matrix(V.raster(s, d), 6))))
GROUPS = {"walls": [0, 1], "marks": [2, 3, 4]}
query("a10_group_collapsed", duck("v_raster", f"select group_name, {RATES} from x", conf=CONF.format("v_raster", 6), m="select * from (values ('walls', [0, 1]), ('marks', [2, 3, 4]), ('COMBINED_GROUPS', [0, 1, 2, 3, 4])) t(group_name, m)", x="""select group_name, cast(sum(case when list_contains(m, gt) and list_contains(m, pred) then n else 0 end) as bigint) tp,
  cast(sum(case when not list_contains(m, gt) and list_contains(m, pred) then n else 0 end) as bigint) fp, cast(sum(case when list_contains(m, gt) and not list_contains(m, pred) then n else 0 end) as bigint) fn from conf, m group by group_name"""))(lambda s, d: rounded(M.group_metrics_collapsed(M.confusion_matrix(V.raster(s, d), 6), GROUPS)))
query("a11_group_mean", duck("v_raster", "select case when class_id < 2 then 'walls' else 'marks' end group_name, round(avg(iou), 6) iou, round(avg(dice), 6) dice from classes where class_id < 5 group by 1", **RASTER))(lambda s, d: rounded(M.group_metrics_mean(M.class_metrics(raster_totals(s, d)), GROUPS)))
query("a12_class_weights", duck("v_pair", "select class_id, round(inv / avg(inv) over (), 6) weight from (select class_id, 1.0::double / ((select count(*) from v_pair where gt = class_id) + 1) inv from (select unnest(range(4))::int class_id))"))(lambda s, d: rounded(M.class_weights(V.pairs(s, d), 4)))
BOUND = """select image_id, y, x, {0} label, greatest(1, cast(round_even(0.05 * sqrt(h * h + w * w), 0) as int)) d from {1} where gt <> 255"""
INNER = """select b.image_id, b.y, b.x, b.label from {0} b join {0} o on o.image_id = b.image_id and o.label = b.label and o.y between b.y - b.d and b.y + b.d and o.x between b.x - b.d and b.x + b.d group by all having count(*) = max((2 * b.d + 1) * (2 * b.d + 1))"""
query("a13_boundary_areas", duck("v_raster", """select coalesce(g.image_id, p.image_id) image_id, coalesce(g.label, p.label) class_id, cast(count(case when g.y is not null and p.y is not null then 1 end) as bigint) a_inter, count(*) a_union, count(p.y) a_pred, count(g.y) a_gt
  from eg g full join ep p on g.image_id = p.image_id and g.label = p.label and g.y = p.y and g.x = p.x group by 1, 2""", small="select * from v_raster where image_id % 4 = 1", g=BOUND.format("gt", "small"), p=BOUND.format("pred", "small"), ig=INNER.format("g"), ip=INNER.format("p"), eg="select g.image_id, g.y, g.x, g.label from g anti join ig on g.image_id = ig.image_id and g.y = ig.y and g.x = ig.x", ep="select p.image_id, p.y, p.x, p.label from p anti join ip on p.image_id = ip.image_id and p.y = ip.y and p.x = ip.x").replace(" where image_id % 4 = 1", ""))(lambda s, d: M.boundary_areas(V.raster(s, d), 0.05))
query("a14_average_over_datasets", duck("v_raster", "select 'm_iou' metric, round(avg(m), 6) as value from (select avg(a_inter::double / nullif(a_union, 0)) m from (select image_id % 3 ds, class_id, sum(a_inter) a_inter, sum(a_union) a_union from areas group by all) group by ds)", areas=RASTER["areas"]))(
    lambda s, d: rounded(M.average_over_datasets(M.mean_metrics(M.total_areas(raster_areas(s, d).withColumn("dataset", F.col("image_id") % 3), ["dataset"]), by=["dataset"]).select(F.lit("m_iou").alias("metric"), F.col("m_iou").alias("value")))))
query("a15_concat_eval", duck("v_raster", "select dataset, round(avg(i::double / nullif(u, 0)), 6) m_iou, round(avg(i::double / nullif(g, 0)), 6) m_acc from (select image_id % 3 dataset, class_id, sum(a_inter) i, sum(a_union) u, sum(a_gt) g from areas group by grouping sets ((1, 2), (2))) group by dataset", areas=RASTER["areas"]))(
    lambda s, d: rounded(M.concat_eval(raster_areas(s, d).withColumn("dataset", F.col("image_id") % 3))))

SCORES = {"scores": "select image_id, node, gt, class_id, list_sum(list_transform(range(1, len(feat) + 1), lambda i: feat[i] * class_feat[i])) score from v_patch, v_class"}


def scores(spark, sf):
    from rasterlake.operators.graph import zero_shot_scores

    p = V.patches(spark, sf)
    return zero_shot_scores(p, V.class_vectors(spark, sf), ["image_id", "node", "gt"])


RANKED = "select *, row_number() over (partition by image_id, node order by round(score, 9) desc, class_id) rank from scores"
query("a16_topk_accuracy", duck("v_patch v_class", "select round(100.0 * (sum(case when r <= 1 then 1 else 0 end) + 1.1920928955078125e-07) / (count(*) + 1.1920928955078125e-07), 6) top1, round(100.0 * (sum(case when r <= 3 then 1 else 0 end) + 1.1920928955078125e-07) / (count(*) + 1.1920928955078125e-07), 6) top3 from (select image_id, node, min(case when class_id = gt then rank end) r from ranked group by 1, 2)", **SCORES, ranked=RANKED))(
    lambda s, d: rounded(M.topk_accuracy(scores(s, d).withColumn("score", F.round("score", 9)), ["image_id", "node"], (1, 3))))
query("t01_argmax_label", duck("v_patch v_class", "select image_id, node, class_id as label from ranked where rank = 1", **SCORES, ranked=RANKED))(lambda s, d: M.argmax_label(scores(s, d).withColumn("score", F.round("score", 9)), ["image_id", "node"]))
query("w02_rank_classes", duck("v_patch v_class", "select image_id, node, class_id, cast(rank as int) rank from ranked", **SCORES, ranked=RANKED))(lambda s, d: M.rank_classes(scores(s, d).withColumn("score", F.round("score", 9)), ["image_id", "node"]).select("image_id", "node", "class_id", "rank"))
LOGP = {"logp": "select *, score - m - ln(sum(exp(score - m)) over (partition by image_id, node)) lp from (select *, max(score) over (partition by image_id, node) m from scores)"}
query("a17_cross_entropy", duck("v_patch v_class", "select round(sum(-w * lp) / sum(w), 6) loss from (select *, case gt when 0 then 2.0 when 3 then 0.5 else 1.0 end w from logp where class_id = gt)", **SCORES, **LOGP))(lambda s, d: rounded(X.cross_entropy(X.log_softmax(scores(s, d), ["image_id", "node"]), {0: 2.0, 3: 0.5})))
BCE = "(greatest(score, 0.0) - score * t + ln(1 + exp(-abs(score))))"
TARGET = {"target": "select *, case when class_id = gt then 1.0::double else 0.0::double end t, 1 / (1 + exp(-score)) p from scores"}
query("a18_bce", duck("v_patch v_class", f"select round(sum({BCE}) / count(*), 6) loss from target", **SCORES, **TARGET))(lambda s, d: rounded(X.binary_cross_entropy(scores(s, d))))
query("a19_focal", duck("v_patch v_class", f"select round(sum({BCE} * (0.25 * t + 0.75 * (1 - t)) * pow((1 - p) * t + p * (1 - t), 2.0)) / count(*), 6) loss from target", **SCORES, **TARGET))(lambda s, d: rounded(X.focal(scores(s, d), alpha=0.25)))
PROBS = {"probs": "select image_id, node, gt, class_id, exp(lp) score from logp"}


def probs(spark, sf):
    return X.log_softmax(scores(spark, sf), ["image_id", "node"]).withColumn("score", F.exp("logp"))


query("a20_dice_loss", duck("v_patch v_class", "select class_id, round(avg(l), 6) loss from (select image_id, class_id, 1 - (2 * sum(score * t) + 1) / (sum(score * score + t) + 1) l from (select *, case when class_id = gt then 1.0 else 0.0 end t from probs) group by 1, 2) group by class_id", **SCORES, **LOGP, **PROBS))(lambda s, d: rounded(X.dice_loss(probs(s, d))))
query("a21_reduce_with_weight", duck("v_step", "select round(sum(loss * (1 + step % 3)) / (100 + 1.1920928955078125e-07), 4) loss from v_step"))(lambda s, d: rounded(X.reduce_loss(V.steps(s, d).withColumn("weight", 1 + F.col("step") % 3), avg_factor=100.0), 4))
query("w06_lovasz_softmax", duck("v_patch v_class", """select image_id, round(avg(l), 6) loss from (select image_id, class_id, sum(err * (jac - coalesce(pj, 0))) l from (select *, lag(jac) over (partition by image_id, class_id order by err desc, node) pj from
  (select *, 1 - (total - seen) / (total + k - seen) jac from (select *, sum(fg) over (partition by image_id, class_id) total, sum(fg) over w seen, count(*) over w k from (select *, abs(fg - score) err from (select *, case when class_id = gt then 1.0::double else 0.0::double end fg from probs))
  window w as (partition by image_id, class_id order by err desc, node rows between unbounded preceding and current row)) where total > 0)) group by 1, 2) group by image_id""", **SCORES, **LOGP, **PROBS))(lambda s, d: rounded(X.lovasz_softmax(probs(s, d).withColumnRenamed("node", "pixel"), ["image_id"])))
query("w07_lovasz_hinge", duck("v_patch", """select image_id, round(sum(greatest(err, 0.0) * (jac - coalesce(pj, 0))), 6) loss from (select *, lag(jac) over (partition by image_id order by err desc, node) pj from
  (select *, 1 - (total - seen) / (total + k - seen) jac from (select *, sum(fg) over (partition by image_id) total, sum(fg) over w seen, count(*) over w k from (select *, 1 - score * (2 * fg - 1) err from (select image_id, node, case when gt < 5 then 1.0::double else 0.0::double end fg, feat[1] * 10 score from v_patch))
  window w as (partition by image_id order by err desc, node rows between unbounded preceding and current row)) where total > 0)) group by image_id"""))(lambda s, d: rounded(X.lovasz_hinge(V.patches(s, d).select("image_id", F.col("node").alias("pixel"), (F.col("gt") < 5).cast("int").alias("gt"), (F.element_at("feat", 1) * 10).alias("score")), ["image_id"])))



def numbered_probs(spark, sf):
    return probs(spark, sf).withColumn("pixel", F.col("image_id") * 100 + F.col("node"))


def binary_logits(spark, sf):
    return V.patches(spark, sf).select("image_id", (F.col("image_id") * 100 + F.col("node")).alias("pixel"), (F.col("gt") < 5).cast("int").alias("gt"), (F.element_at("feat", 1) * 10).alias("score"))


query("w06_lovasz_softmax_corpus", duck("v_patch v_class", """select round(avg(l), 6) loss from (select class_id, sum(err * (jac - coalesce(pj, 0))) l from (select *, lag(jac) over (partition by class_id order by err desc, image_id, node) pj from
  (select *, 1 - (total - seen) / (total + k - seen) jac from (select *, sum(fg) over (partition by class_id) total, sum(fg) over w seen, count(*) over w k from (select *, abs(fg - score) err from (select *, case when class_id = gt then 1.0::double else 0.0::double end fg from probs))
  window w as (partition by class_id order by err desc, image_id, node rows between unbounded preceding and current row)) where total > 0)) group by 1)""", **SCORES, **LOGP, **PROBS))(lambda s, d: rounded(X.lovasz_softmax(numbered_probs(s, d))))
query("w07_lovasz_hinge_corpus", duck("v_patch", """select round(sum(greatest(err, 0.0) * (jac - coalesce(pj, 0))), 6) loss from (select *, lag(jac) over (order by err desc, image_id, node) pj from
  (select *, 1 - (total - seen) / (total + k - seen) jac from (select *, sum(fg) over () total, sum(fg) over w seen, count(*) over w k from (select *, 1 - score * (2 * fg - 1) err from (select image_id, node, case when gt < 5 then 1.0::double else 0.0::double end fg, feat[1] * 10 score from v_patch))
  window w as (order by err desc, image_id, node rows between unbounded preceding and current row)) where total > 0))"""))(lambda s, d: rounded(X.lovasz_hinge(binary_logits(s, d))))


def truth_probs(spark, sf):
    return probs(spark, sf).where("class_id = gt").select((F.col("image_id") * 100 + F.col("node")).alias("pixel"), F.round("score", 9).alias("p"), F.round(-F.col("logp"), 9).alias("loss"))


TRUTH = {"truth": "select image_id * 100 + node pixel, round(exp(lp), 9) p, round(-lp, 9) loss from logp where class_id = gt"}
query("t05_hard_by_threshold", duck("v_patch v_class", "select pixel, case when p < greatest(0.05, (select max(p) from (select p from truth order by p limit 51))) then 1.0 else 0.0 end weight from truth", **SCORES, **LOGP, **TRUTH))(lambda s, d: X.hard_by_threshold(truth_probs(s, d), 0.05, 10, 5).select("pixel", "weight"))
query("t06_hard_by_loss", duck("v_patch v_class", "select pixel, case when row_number() over (order by loss desc, pixel) <= 50 then 1.0 else 0.0 end weight from truth", **SCORES, **LOGP, **TRUTH))(lambda s, d: X.hard_by_loss(truth_probs(s, d), 10, 5).select("pixel", "weight"))


def pixel_losses(spark, sf):
    """A probability and a loss of every pixel of the rasters, with many ties."""
    q = (F.col("image_id") * 31 + F.col("y") * 57 + F.col("x") * 101) % 1009
    return V.raster(spark, sf).select((F.col("image_id") * 1000000 + F.col("y") * 1000 + F.col("x")).alias("pixel"), ((q + 1) / 1010.0).alias("p"), (q * q / 1009.0).alias("loss"))


PIXEL_LOSS = {"pl": "select image_id * 1000000 + y * 1000 + x pixel, (q + 1) / 1010.0::double p, q * q / 1009.0::double loss from (select *, (image_id * 31 + y * 57 + x * 101) % 1009 q from v_raster)", "im": "select count(*) n from v_image"}
query("t05_hard_pixels", duck("v_raster", "select pixel, case when p < greatest(0.05::double, (select max(p) from (select p, row_number() over (order by p) r from pl), im where r <= 500 * n + 1)) then 1.0::double else 0.0::double end weight from pl", **PIXEL_LOSS))(lambda s, d: X.hard_by_threshold(pixel_losses(s, d), 0.05, 500, V.images(s, d).count()).select("pixel", "weight"))
query("t06_hard_pixels", duck("v_raster", "select pixel, case when row_number() over (order by loss desc, pixel) <= 500 * (select n from im) then 1.0::double else 0.0::double end weight from pl", **PIXEL_LOSS))(lambda s, d: X.hard_by_loss(pixel_losses(s, d), 500, V.images(s, d).count()).select("pixel", "weight"))


def points(spark, sf):
    rows = scores(spark, sf).withColumn("score", F.round("score", 9))
    return X.uncertainty(rows, ["image_id", "node"]).select("image_id", F.floor(F.col("node") / 10).alias("y"), (F.col("node") % 10).alias("x"), F.round("uncertainty", 8).alias("uncertainty"), F.lit(10).alias("h"), F.lit(10).alias("w"))


POINTS = {"points": "select image_id, node // 10 y, node % 10 x, round(max(case when rank = 2 then round(score, 9) end) - max(case when rank = 1 then round(score, 9) end), 8) uncertainty from ranked group by image_id, node"}
query("t07_most_uncertain_points", duck("v_patch v_class", "select image_id, y, x, cast(rank as int) rank, uncertainty, (x + 0.5) / 10 cx, (y + 0.5) / 10 cy from (select *, row_number() over (partition by image_id order by uncertainty desc, y, x) rank from points) where rank <= 7", **SCORES, ranked=RANKED, **POINTS))(lambda s, d: X.most_uncertain(points(s, d), 7))


def draw_order(salt: int):
    from rasterlake.functions.scalars import draw

    return draw(F.col("image_id") * 100 + F.col("y") * 10 + F.col("x"), salt)


query("t08_importance_sample", duck("v_patch v_class", """select image_id, y, x, 'important' kind from (select *, row_number() over (partition by image_id order by uncertainty desc, y, x) r from drawn where dr <= 24) where r <= 6
  union all select image_id, y, x, 'random' from drawn where dr > 24 and dr <= 26""", **SCORES, ranked=RANKED, **POINTS, drawn=f"select *, row_number() over (partition by image_id order by {V.duck_draw('image_id * 100 + y * 10 + x', 5)}, y, x) dr from points"))(lambda s, d: X.importance_sample(points(s, d), 8, 3.0, 0.75, draw_order(5)).select("image_id", "y", "x", "kind"))

query("a24_class_histogram", duck("v_raster", "select image_id, gt, count(*) n from v_raster group by all"))(lambda s, d: M.class_histogram(V.raster(s, d)))
query("u05_present_classes", duck("v_raster", "select distinct image_id, c class_id from (select image_id, gt c from v_raster union select image_id, pred from v_raster) where c <> 255"))(lambda s, d: M.present_classes(V.raster(s, d)))
query("l01_remap_labels", duck("v_raster", "select image_id, y, x, case gt when 0 then 3 when 1 then 0 when 3 then 255 else gt end label from v_raster"))(lambda s, d: V.raster(s, d).select("image_id", "y", "x", L.remap(F.col("gt"), {0: 3, 1: 0, 3: 255}).alias("label")))
query("l01_stuff_train_ids", "select doc_id, v, case when v in (11, 25, 28, 29, 44, 65, 67, 68, 70, 82, 90) or (v > 181) then v else v - len(list_filter([11, 25, 28, 29, 44, 65, 67, 68, 70, 82, 90], lambda g: g < v)) end train_id from (select doc_id, cast(n_chars % 256 as int) v from documents)")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", (F.col("n_chars") % 256).cast("int").alias("v")).withColumn("train_id", L.remap(F.col("v"), L.stuff_map())))
query("l01_object_ids", "select doc_id, v, case when (v > 90 and v <= 181) or v = 255 then 0 when v in (11, 25, 28, 29, 44, 65, 67, 68, 70, 82, 90) or v > 181 then v else v - len(list_filter([11, 25, 28, 29, 44, 65, 67, 68, 70, 82, 90], lambda g: g < v)) + 1 end object_id from (select doc_id, cast(n_chars % 256 as int) v from documents)")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", (F.col("n_chars") % 256).cast("int").alias("v")).withColumn("object_id", L.remap(F.col("v"), L.object_map())))
query("l02_reduce_zero_label", duck("v_raster", "select image_id, y, x, cast(case when gt in (0, 255) then 255 else gt - 1 end as int) label from v_raster"))(lambda s, d: V.raster(s, d).select("image_id", "y", "x", L.reduce_zero_label(F.col("gt")).alias("label")))
query("l03_mask_ignore", duck("v_raster", "select image_id, count(*) n from v_raster where gt <> 255 group by image_id"))(lambda s, d: L.mask_ignore(V.raster(s, d)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n")))
query("l04_invalid_to_ignore", duck("v_raster", "select image_id, y, x, case when pred < 0 or pred >= 4 then 255 else pred end label from v_raster"))(lambda s, d: V.raster(s, d).select("image_id", "y", "x", L.invalid_to_ignore(F.col("pred"), 4).alias("label")))
query("l05_propagate_ignore", duck("v_raster", "select image_id, y, x, case when gt = 255 then 255 else pred end pred from v_raster"))(lambda s, d: V.raster(s, d).select("image_id", "y", "x", L.propagate_ignore(F.col("gt"), F.col("pred")).alias("pred")))
query("j05_join_pred_gt", duck("v_raster", "select image_id, gt, pred, count(*) n from v_raster group by all"))(lambda s, d: L.join_pred_gt(V.raster(s, d).select("image_id", "y", "x", F.col("pred").alias("label")), V.raster(s, d).select("image_id", "y", "x", F.col("gt").alias("label"))).groupBy("image_id", "gt", "pred").agg(F.count(F.lit(1)).alias("n")))
PALETTE = L.bit_palette(21)
_pal = lambda ch: "[" + ", ".join(str(c[ch]) for c in PALETTE) + "]"
query("l12_colorize", duck("v_raster", f"select image_id, y, x, {', '.join(f'{_pal(i)}[gt % 21 + 1] c{c}' for i, c in enumerate('rgb'))} from v_raster"))(lambda s, d: L.colorize(V.raster(s, d), PALETTE, "gt").select("image_id", "y", "x", "cr", "cg", "cb"))
query("l13_overlay_blend", duck("v_raster", f"select image_id, y, x, {', '.join(f'cast(case when gt in (0, 255) then {c} else least(255, floor({c} * (1 - 0.4::double) + {_pal(i)}[gt + 1] * 0.4::double)) end as int) out_{c}' for i, c in enumerate('rgb'))} from v_raster"))(lambda s, d: L.overlay(V.raster(s, d), PALETTE, 0.4, "gt").select("image_id", "y", "x", "out_r", "out_g", "out_b"))
query("l13_overlay_rgba", duck("v_raster", f"select image_id, y, x, {', '.join(f'cast(case when gt in (0, 255) then {c} else least(255, floor(({c} * (255 - 102) + {_pal(i)}[gt + 1] * 102) / 255.0::double + 0.5)) end as int) out_{c}' for i, c in enumerate('rgb'))} from v_raster"))(
    lambda s, d: L.overlay(V.raster(s, d), PALETTE, 0.4, "gt", rounding="rgba").select("image_id", "y", "x", "out_r", "out_g", "out_b"))
query("j04_palette_inverse", duck("v_raster", "select image_id, y, x, case when gt = 255 then null else gt end label from v_raster"))(lambda s, d: L.palette_inverse(L.colorize(V.raster(s, d), PALETTE, "gt", wrap=False).select("image_id", "y", "x", F.when(F.col("gt") == 255, 1).otherwise(F.col("cr")).alias("r"), F.col("cg").alias("g"), F.col("cb").alias("b")), PALETTE).select("image_id", "y", "x", "label"))
query("l16_random_palette", "select l_orderkey % 12 class_id, " + ", ".join(f"{V.duck_draw(f'(3 * (l_orderkey % 12) + {i})', 9)} % 256 {c}" for i, c in enumerate("rgb")) + ", count(*) n from lineitem group by all")(
    lambda s, d: L.colorize(V.table(s, d, "lineitem").select((F.col("l_orderkey") % 12).alias("class_id")), L.random_palette(12, 9), "class_id").groupBy("class_id", F.col("cr").cast("long").alias("r"), F.col("cg").cast("long").alias("g"), F.col("cb").cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n")))
query("s16_format_results", duck("v_raster", "select image_id, y, x, pred + 1 ade, [7, 8, 11, 12, 13, 17][pred + 1] cityscapes from v_raster"))(lambda s, d: V.raster(s, d).select("image_id", "y", "x", L.format_labels(F.col("pred"), "ade").alias("ade"), L.format_labels(F.col("pred"), "cityscapes").alias("cityscapes")))
