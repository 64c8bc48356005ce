"""Queries of vectors, graphs, windows and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions.scalars import affinity, clamp_power, dot, lab, norm, normalise, squared_distance
from rasterlake.operators import graph as G
from rasterlake.operators import metrics as M
from rasterlake.operators import raster as R
from rasterlake.plans import fixtures as V
from rasterlake.plans.fixtures import duck
from rasterlake.plans.metric_queries import RANKED, SCORES, areas_sql, scores
from rasterlake.plans.registry import query, rounded

DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def nodes(spark, sf):
    return V.patches(spark, sf).withColumnRenamed("image_id", "graph_id")


def centers(spark, sf):
    return G.patch_centers(nodes(spark, sf), 16)


def edges(spark, sf, k=10):
    """Normalised symmetric affinities of the k nearest patches."""
    near = G.knn_join(nodes(spark, sf), k)
    return G.normalize_graph(G.symmetrize(G.knn_affinity(near, centers(spark, sf), 3.0, 0.01)))


KNN = {
    "sims": f"select a.image_id graph_id, a.node src, b.node dst, {DOT.format('a.feat', 'b.feat')} sim from v_patch a join v_patch b on a.image_id = b.image_id",
    "knn": "select * from (select *, row_number() over (partition by graph_id, src order by sim desc, dst) rank from sims) where rank <= 10",
}
AFF = {
    "ctr": "select image_id graph_id, node, 8 + py * 16 cy, 8 + px * 16 cx from v_patch",
    "aff": "select k.graph_id, src, dst, pow(greatest(sim, 0.0), 3.0) * exp(-0.01::double * sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx))) w from knn k join ctr a on k.graph_id = a.graph_id and k.src = a.node join ctr b on k.graph_id = b.graph_id and k.dst = b.node",
    "sym": "select graph_id, src, dst, sum(w) w from (select graph_id, src, dst, w from aff union all select graph_id, dst, src, w from aff) group by all",
    "off": "select * from sym where src <> dst",
    "deg": "select graph_id, src, case when sum(w) = 0 then 1 else sum(w) end s from off group by all",
    "wn": "select o.graph_id, o.src, o.dst, o.w / sqrt(a.s) / sqrt(b.s) w from off o join deg a on o.graph_id = a.graph_id and o.src = a.src join deg b on o.graph_id = b.graph_id and o.dst = b.src",
}


def cg_sql(start: str, edges: str, p: str = "") -> dict[str, str]:
    """Ten conjugate-gradient steps as SQL tables; the last is `{p}s10`."""
    out = {f"{p}s0": start, f"{p}lim": f"select graph_id, class_id, sum(r * r) * 1e-12 l from {p}s0 group by all"}
    for i in range(10):
        out |= {
            f"{p}v{i}": f"select e.graph_id, e.src node, t.class_id, sum(e.w * t.p) v from {edges} e join {p}s{i} t on e.graph_id = t.graph_id and e.dst = t.node group by all",
            f"{p}q{i}": f"select s.*, s.p - 0.95::double * coalesce(m.v, 0) q from {p}s{i} s left join {p}v{i} m on s.graph_id = m.graph_id and s.node = m.node and s.class_id = m.class_id",
            f"{p}a{i}": f"select q.graph_id, q.class_id, sum(r * r) rho, case when sum(r * r) <= min(l) then 0 else coalesce(sum(r * r) / nullif(sum(p * q), 0), 0) end a from {p}q{i} q join {p}lim l on q.graph_id = l.graph_id and q.class_id = l.class_id group by all",
            f"{p}m{i}": f"select q.graph_id, node, q.class_id, x + a * p x, r - a * q r, p, rho from {p}q{i} q join {p}a{i} a on q.graph_id = a.graph_id and q.class_id = a.class_id",
            f"{p}z{i}": f"select graph_id, class_id, sum(r * r) rho2 from {p}m{i} group by all",
            f"{p}s{i + 1}": f"select m.graph_id, node, m.class_id, x, r, r + coalesce(rho2 / nullif(rho, 0), 0) * p p from {p}m{i} m join {p}z{i} z on m.graph_id = z.graph_id and m.class_id = z.class_id",
        }
    return out


CG = cg_sql("select image_id graph_id, node, class_id, 0.0::double x, score r, score p from scores", "wn")

query("g01_zero_shot_scores", duck("v_patch v_class", "select image_id, node, gt, class_id, round(score, 6) score from scores", **SCORES))(lambda s, d: rounded(scores(s, d)))
query("f03_softmax_temperature", duck("v_patch v_class", "select image_id, node, class_id, round(e / sum(e) over (partition by image_id, node), 6) score from (select *, exp((score - max(score) over (partition by image_id, node)) * 100) e from scores)", **SCORES))(
    lambda s, d: rounded(G.zero_shot_scores(V.patches(s, d), V.class_vectors(s, d), ["image_id", "node"], 100.0)))
query("f02_vector_functions", duck("v_patch", f"select image_id, node, round(sqrt({DOT.format('feat', 'feat')}), 6) norm, round(feat[1] / sqrt({DOT.format('feat', 'feat')}), 6) first, round(list_sum(list_transform(feat, lambda x: (x - 0.1) * (x - 0.1))), 6) far, round(0.1 * list_sum(feat), 6) dot from v_patch"))(
    lambda s, d: rounded(V.patches(s, d).withColumn("c", F.transform("feat", lambda x: F.lit(0.1))).select("image_id", "node", norm(F.col("feat")).alias("norm"), F.element_at(normalise(F.col("feat")), 1).alias("first"), squared_distance(F.col("feat"), F.col("c")).alias("far"), dot(F.col("feat"), F.col("c")).alias("dot"))))
query("f04_affinity_functions", duck("v_patch", "select image_id, node, round(exp(-0.01::double * pow(sqrt(px * px + py * py), 2.0)), 6) near, round(pow(greatest(feat[1], 0.0), 3.0), 6) alike from v_patch"))(
    lambda s, d: rounded(V.patches(s, d).select("image_id", "node", affinity(F.sqrt((F.col("px") * F.col("px") + F.col("py") * F.col("py")).cast("double")), 0.01, 2.0).alias("near"), clamp_power(F.element_at("feat", 1), 3.0).alias("alike"))))
query("m00_zero_shot_mean_iou", duck("v_patch v_class", "select round((select sum(a_inter)::double / sum(a_gt) from t), 6) a_acc, round(avg(a_inter::double / nullif(a_union, 0)), 6) m_iou, round(avg(a_inter::double / nullif(a_gt, 0)), 6) m_acc from t", **SCORES, ranked=RANKED, lab="select image_id, gt, class_id pred from ranked where rank = 1", areas=areas_sql("lab", 10), t="select class_id, sum(a_inter) a_inter, sum(a_union) a_union, sum(a_gt) a_gt from areas group by class_id"))(
    lambda s, d: rounded(M.mean_metrics(M.total_areas(M.areas_per_image(M.argmax_label(scores(s, d).withColumn("score", F.round("score", 9)), ["image_id", "node", "gt"]).withColumnRenamed("label", "pred"), 10))).select("a_acc", "m_iou", "m_acc")))
query("a25_prompt_mean", duck("v_patch", f"select gt, unnest(range(len(m)))::int d, round(unnest(list_transform(m, lambda x: x / sqrt({DOT.format('m', 'm')}))), 6) v from (select gt, list(v order by d) m from (select gt, d, avg(v) v from (select gt, unnest(range(len(feat))) d, unnest(list_transform(feat, lambda x: x / sqrt({DOT.format('feat', 'feat')}))) v from v_patch) group by gt, d) group by gt)"))(
    lambda s, d: rounded(G.prompt_mean(V.patches(s, d), ["gt"]).select("gt", F.posexplode("feat").alias("d", "v"))))
query("j10_knn_join", duck("v_patch", "select graph_id, src, dst, round(sim, 6) sim, cast(rank as int) rank from knn", **KNN))(lambda s, d: rounded(G.knn_join(nodes(s, d), 10)))
query("j10_knn_join_plain", duck("v_patch", "select graph_id, src, dst, round(sim, 6) sim, cast(rank as int) rank from knn", **KNN))(lambda s, d: rounded(G.knn_join_plain(nodes(s, d), 10)))
query("j10_knn_join_pruned", duck("v_patch", "select graph_id, src, dst, round(sim, 6) sim, cast(rank as int) rank from knn", **KNN))(lambda s, d: rounded(G.knn_join_pruned(nodes(s, d), 10, 16)[0]))
query("g02_knn_affinity", duck("v_patch", "select graph_id, src, dst, round(w, 6) w from aff", **KNN, ctr=AFF["ctr"], aff=AFF["aff"]))(lambda s, d: rounded(G.knn_affinity(G.knn_join(nodes(s, d), 10), centers(s, d), 3.0, 0.01)))
query("g03_geometry_affinity", duck("v_patch", "select k.graph_id, src, dst, round(exp(-0.01::double * sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx))), 6) w from knn k join ctr a on k.graph_id = a.graph_id and k.src = a.node join ctr b on k.graph_id = b.graph_id and k.dst = b.node", **KNN, ctr=AFF["ctr"]))(lambda s, d: rounded(G.knn_affinity(G.knn_join(nodes(s, d), 10), centers(s, d), 0.0, 0.01)))
query("g04_symmetrize", duck("v_patch", "select graph_id, src, dst, round(w, 6) w from sym", **KNN, **{k: AFF[k] for k in ("ctr", "aff", "sym")}))(lambda s, d: rounded(G.symmetrize(G.knn_affinity(G.knn_join(nodes(s, d), 10), centers(s, d), 3.0, 0.01))))
query("g05_normalize_graph", duck("v_patch", "select graph_id, src, dst, round(w, 6) w from wn", **KNN, **AFF))(lambda s, d: rounded(edges(s, d)))


def starts(spark, sf):
    return scores(spark, sf).select(F.col("image_id").alias("graph_id"), "node", "class_id", F.col("score").alias("y"))


query("g06_laplacian", duck("v_patch v_class", "select s.image_id graph_id, s.node, s.class_id, round(s.score - 0.95::double * coalesce(m.v, 0), 5) lx from scores s left join (select e.graph_id, e.src node, t.class_id, sum(e.w * t.score) v from wn e join scores t on e.graph_id = t.image_id and e.dst = t.node group by all) m on s.image_id = m.graph_id and s.node = m.node and s.class_id = m.class_id", **KNN, **AFF, **SCORES))(
    lambda s, d: rounded(G.laplacian(starts(s, d).withColumnRenamed("y", "x"), edges(s, d), 0.95).select("graph_id", "node", "class_id", "lx"), 5))
query("g08_label_propagation", duck("v_patch v_class", "select graph_id, node, class_id, round(x, 4) x from s10", **KNN, **AFF, **SCORES, **CG))(lambda s, d: rounded(G.propagate(edges(s, d), starts(s, d)), 4))
query("g08_label_propagation_grouped", duck("v_patch v_class", "select graph_id, node, class_id, round(x, 4) x from s10", **KNN, **AFF, **SCORES, **CG))(lambda s, d: rounded(G.propagate_in_groups(edges(s, d), starts(s, d)), 4))
query("g09_patch_propagation", duck("v_patch v_class", "select graph_id image_id, node, class_id as label from (select *, row_number() over (partition by graph_id, node order by round(x, 6) desc, class_id) rk from s10) where rk = 1", **KNN, **AFF, **SCORES, **CG))(
    lambda s, d: M.argmax_label(G.propagate(edges(s, d), starts(s, d)).select(F.col("graph_id").alias("image_id"), "node", "class_id", F.round("x", 6).alias("score")), ["image_id", "node"]))
query("g13_saliency_map", duck("v_patch v_class", "select image_id, node, class_id, round(coalesce((s - lo) / nullif(hi - lo, 0), 0), 6) saliency from (select *, min(s) over w lo, max(s) over w hi from (select *, greatest(score, 0.0) s from scores) window w as (partition by image_id, class_id))", **SCORES))(lambda s, d: rounded(G.saliency(V.patches(s, d), V.class_vectors(s, d))))
query("g14_feature_fusion", duck("v_patch v_class", "select image_id, node, class_id, round((score + score * score) / 2, 6) score from scores", **SCORES))(lambda s, d: rounded(scores(s, d).select("image_id", "node", "class_id", G.fuse(F.col("score"), F.col("score") * F.col("score"), "add").alias("score"))))
query("a26_synonym_max_reduce", duck("v_patch v_class", "select image_id, node, greatest(class_id - 2, 0) class_id, round(max(score), 6) score from scores group by image_id, node, greatest(class_id - 2, 0)", **SCORES))(lambda s, d: rounded(G.synonym_max(scores(s, d), ["image_id", "node"], 3)))
query("a29_soft_codebook", duck("v_patch v_class", "select image_id, class_id code_id, d, round(sum(a * (f - c)), 5) v from (select image_id, class_id, e / sum(e) over (partition by image_id, node) a, feat, class_feat from (select *, exp(s - max(s) over (partition by image_id, node)) e from (select *, -list_sum(list_transform(range(1, len(feat) + 1), lambda i: (feat[i] - class_feat[i]) * (feat[i] - class_feat[i]))) s from v_patch, v_class))) x, lateral (select unnest(range(len(feat)))::int d, unnest(feat) f, unnest(class_feat) c) group by all"))(
    lambda s, d: rounded(G.soft_codebook(V.patches(s, d), V.class_vectors(s, d).select(F.col("class_id").alias("code_id"), F.col("class_feat").alias("code_feat"))), 5))

WIN = {"win": "select image_id, h, w, i * (nw + 1) + j window_id, greatest(least(i * 12 + 20, h) - 20, 0) y1, least(i * 12 + 20, h) y2, greatest(least(j * 12 + 20, w) - 20, 0) x1, least(j * 12 + 20, w) x2 from (select *, unnest(range(nw + 1)) j from (select *, unnest(range(nh + 1)) i from (select *, greatest(h - 20 + 11, 0) // 12 nh, greatest(w - 20 + 11, 0) // 12 nw from v_image)))"}
query("r01_sliding_windows", duck("v_image", "select image_id, h, w, window_id, y1, y2, x1, x2 from win", **WIN))(lambda s, d: G.windows(V.images(s, d), 20, 12))
WPIX = {"wp": "select image_id, window_id, y, x from (select *, unnest(range(x1, x2)) x from (select *, unnest(range(y1, y2)) y from win))"}
query("j09_window_pixels", duck("v_image", "select image_id, y, x, count(*) n from wp group by all", **WIN, **WPIX))(lambda s, d: G.covering_windows(V.grid(V.images(s, d)), 20, 12).groupBy("image_id", "y", "x").agg(F.count(F.lit(1)).alias("n")))


def window_scores(spark, sf):
    """A score of two classes per window pixel, from its colour."""
    cells = G.covering_windows(V.raster(spark, sf).select("image_id", "h", "w", "y", "x", "r", "g"), 20, 12)
    return cells.select("image_id", "window_id", "y", "x", F.inline(F.array(*[F.struct(F.lit(c).alias("class_id"), ((F.col(v) + F.col("window_id") * 3) % 97 / 97.0).alias("score")) for c, v in ((0, "r"), (1, "g"))])))


WSC = {"ws": "select w.*, c class_id, ((case c when 0 then r else g end + window_id * 3) % 97) / 97.0::double score from wp w join v_raster p on w.image_id = p.image_id and w.y = p.y and w.x = p.x, (values (0), (1)) t(c)"}
query("a27_overlap_merge", duck("v_raster", "select image_id, y, x, class_id, round(avg(score), 6) score, count(*) n_windows from ws group by all", **WIN, **WPIX, **WSC))(lambda s, d: rounded(G.overlap_merge(window_scores(s, d))))
query("g11_window_flatten", duck("v_image", "select image_id, window_id, y, x, row_number() over (partition by image_id order by window_id, y, x) - 1 node from wp", **WIN, **WPIX))(
    lambda s, d: G.node_ids(G.window_pixels(G.windows(V.images(s, d), 20, 12)), "image_id", ("window_id", "y", "x")).select("image_id", "window_id", "y", "x", "node"))
query("r03_patch_centers", duck("v_patch", "select image_id graph_id, node, 8 + py * 16 cy, 8 + px * 16 cx from v_patch"))(lambda s, d: centers(s, d).select("graph_id", "node", "cy", "cx"))
LIN = "case when {0} / 255.0::double <= 0.04045 then {0} / 255.0::double / 12.92 else pow(({0} / 255.0::double + 0.055) / 1.055, 2.4) end"
FT = "case when {0} > 0.008856 then pow({0}, 1.0::double / 3) else 7.787 * {0} + 16.0::double / 116 end"
LAB = {
    "lin": f"select image_id, y, x, {', '.join(LIN.format(c) + ' l' + c for c in 'rgb')} from v_raster",
    "xyz": "select image_id, y, x, (0.412453::double * lr + 0.357580::double * lg + 0.180423::double * lb) / 0.950456::double xx, 0.212671::double * lr + 0.715160::double * lg + 0.072169::double * lb yy, (0.019334::double * lr + 0.119193::double * lg + 0.950227::double * lb) / 1.088754::double zz from lin",
    "ft": f"select image_id, y, x, {FT.format('xx')} fx, {FT.format('yy')} fy, {FT.format('zz')} fz from xyz",
    "lab": "select image_id, y, x, (116 * fy - 16) / 100 l, 500 * (fx - fy) / 128 a, 200 * (fy - fz) / 128 bb from ft",
}
query("f05_srgb_to_lab", duck("v_raster", "select image_id, y, x, round(l, 6) + 0.0 l, round(a, 6) + 0.0 a, round(bb, 6) + 0.0 bb from lab", **LAB))(lambda s, d: rounded(V.raster(s, d).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(lab(F.col("r"), F.col("g"), F.col("b")), ("l", "a", "bb"), strict=True)])))


def grid_edges_sql(lab_table: str, neigh: int, tau: float) -> dict[str, str]:
    """Edges of pixels (graph_id, y, x, l, a, bb) by equality joins only: each pixel's places first, then the pixel at each place."""
    steps = ", ".join(f"({dy}, {dx})" for dy in range(-neigh, neigh + 1) for dx in range(-neigh, neigh + 1) if dy or dx)
    return {
        "there": f"select graph_id, y, x, l, a, bb, y + dy y2, x + dx x2 from {lab_table}, (values {steps}) t(dy, dx)",
        "grid": f"select p.graph_id, p.y * 100000 + p.x src, q.y * 100000 + q.x dst, exp(-1 / {tau}::double * sqrt((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.bb - q.bb) * (p.bb - q.bb))) w from there p join {lab_table} q on q.graph_id = p.graph_id and q.y = p.y2 and q.x = p.x2",
    }


query("g07_pixel_grid_edges", duck("v_raster", "select graph_id, src, dst, round(w, 6) w from grid", **LAB, glab="select image_id graph_id, y, x, l, a, bb from lab", **grid_edges_sql("glab", 1, 0.1)))(
    lambda s, d: rounded(G.pixel_grid_edges(V.raster(s, d), 1, 0.1)))


# The segmentation chain: the vectors of a graph are the 5 x 5 patches of the four windows (20 pixels, 12 apart) of
# a picture of 32 x 32 pixels, which is the raster of supplier graph + 1 resized.


def chain_patches(spark, sf):
    n = F.col("node")
    return V.patches(spark, sf).select("image_id", F.floor(n / 25).alias("window_id"), F.floor(n % 25 / 5).alias("py"), (n % 5).alias("px"), "feat")


def chain_images(spark, sf):
    known = V.patches(spark, sf).select("image_id").distinct()
    edge = F.lit(32).cast("long")
    return V.images(spark, sf).select((F.col("image_id") - 1).alias("image_id"), edge.alias("h"), edge.alias("w"), F.col("h").alias("h0"), F.col("w").alias("w0")).join(known, "image_id", "left_semi")


def chain_pixels(spark, sf):
    own = chain_images(spark, sf).select("image_id", F.col("h0").alias("h"), F.col("w0").alias("w"))
    wanted = own.withColumn("image_id", F.col("image_id") + 1)  # pixels are made for these images alone
    colours = V.raster(spark, sf, wanted).select((F.col("image_id") - 1).alias("image_id"), "y", "x", "r", "g", "b")
    fine = R.resize_bilinear(colours, own, F.lit(32), F.lit(32), ["r", "g", "b"])
    return fine.select("image_id", "y", "x", *[F.floor(F.col(c) + 0.5).cast("int").alias(c) for c in "rgb"])


def bilinear_sql(p: str, images: str, source: str, h: str, w: str, values: str, keys: str = "") -> dict[str, str]:
    """`{p}out`: image_id, y, x, the keys, and sums named as `values` lists; images have h and w."""
    key = "".join(f", s.{k}" for k in keys.split())
    return {
        f"{p}t": f"select *, least(greatest((y + 0.5) * h / {h} - 0.5, 0), h - 1)::double fy, least(greatest((x + 0.5) * w / {w} - 0.5, 0), w - 1)::double fx from (select *, unnest(range({w})) x from (select *, unnest(range({h})) y from {images}))",
        f"{p}f": f"select *, floor(fy)::bigint y0, floor(fx)::bigint x0 from {p}t",
        f"{p}c": f"select image_id, y, x, least(y0 + a, h - 1) sy, least(x0 + b, w - 1) sx, (case a when 1 then fy - y0 else 1 - fy + y0 end) * (case b when 1 then fx - x0 else 1 - fx + x0 end) k from {p}f, (values (0), (1)) ta(a), (values (0), (1)) tb(b)",
        f"{p}out": f"select c.image_id, c.y, c.x{key}, {', '.join(f'sum(k * s.{v}) {v}' for v in values.split())} from {p}c c join {source} s on s.image_id = c.image_id and s.y = c.sy and s.x = c.sx group by c.image_id, c.y, c.x{key}",
    }


LAB_OF = {name: text.replace("v_raster", "cpx") for name, text in LAB.items()}
CHAIN = {
    "cimg": "select image_id - 1 image_id, h, w from v_image where image_id - 1 in (select image_id from v_patch)",
    "craw": "select image_id - 1 image_id, y, x, r, g, b from v_raster",
    **bilinear_sql("p_", "cimg", "craw", "32", "32", "r g b"),
    "cpx": "select image_id, y, x, floor(r + 0.5)::bigint r, floor(g + 0.5)::bigint g, floor(b + 0.5)::bigint b from p_out",
    **KNN, **AFF, **SCORES,
    "ctr": "select image_id graph_id, node, node // 50 * 12 + 2 + node % 25 // 5 * 4 cy, node // 25 % 2 * 12 + 2 + node % 5 * 4 cx from v_patch where image_id in (select image_id from cimg)",
    **CG,
    "wimg": "select distinct graph_id * 4 + node // 25 image_id, 5 h, 5 w from s10",
    "wmap": "select graph_id * 4 + node // 25 image_id, node % 25 // 5 y, node % 5 x, class_id, x score from s10",
    **bilinear_sql("w_", "wimg", "wmap", "20", "20", "score", "class_id"),
    "merged": "select image_id // 4 image_id, y + image_id % 4 // 2 * 12 y, x + image_id % 2 * 12 x, class_id, avg(score) score from w_out group by all",
    **LAB_OF,
    "glab": "select image_id graph_id, y, x, l, a, bb from lab",
    **grid_edges_sql("glab", 2, 0.1),
    "gdeg": "select graph_id, src, case when sum(w) = 0 then 1 else sum(w) end s from grid group by all",
    "gwn": "select o.graph_id, o.src, o.dst, o.w / sqrt(a.s) / sqrt(b.s) w from grid o join gdeg a on o.graph_id = a.graph_id and o.src = a.src join gdeg b on o.graph_id = b.graph_id and o.dst = b.src",
    **cg_sql("select image_id graph_id, y * 100000 + x node, class_id, 0.0::double x, score r, score p from merged", "gwn", "g"),
}
REDUCED = {
    "oimg": "select i.image_id, 32 h, 32 w, i.h h0, i.w w0 from cimg i",
    "true_": "select graph_id image_id, node // 100000 y, node % 100000 x, greatest(class_id - 1, 0) class_id, max(x) score from gs10 group by all",
    **bilinear_sql("o_", "oimg", "true_", "h0", "w0", "score", "class_id"),
}


@query("g10_pixel_refinement", duck("v_image v_raster v_patch v_class", "select graph_id image_id, node // 100000 y, class_id, round(avg(x), 3) + 0.0 score, count(*) n from gs10 group by all", **CHAIN))
def pixel_refinement(spark, sf):
    """Scores of all windows, merged, propagated over the pixels by colour; means of rows of pixels, as ten steps leave few digits of single ones."""
    scores = G.window_scores(chain_patches(spark, sf), V.class_vectors(spark, sf), chain_images(spark, sf), 20, 12, 4, k=10)
    fine = G.refine_pixels(scores, chain_pixels(spark, sf), 2, 0.1)
    return rounded(fine.groupBy("image_id", "y", "class_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")), 3)


@query("g12_segment", duck("v_image v_raster v_patch v_class", "select image_id, y, x, class_id as label from (select *, row_number() over (partition by image_id, y, x order by round(score, 6) desc, class_id) rk from o_out) where rk = 1", **CHAIN, **REDUCED))
def segment(spark, sf):
    """The whole chain: windows, scores, graph, propagation, merging, refinement, reduction, resizing, labels."""
    return G.segment(chain_patches(spark, sf), V.class_vectors(spark, sf), chain_pixels(spark, sf), chain_images(spark, sf), 20, 12, 4, n_background=2, neigh=2, tau=0.1, k=10)
