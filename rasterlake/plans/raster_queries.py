"""Queries of raster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions.scalars import from_hsv, gray, hsv, n_windows, padding, percent, uint8
from rasterlake.operators import graph as G
from rasterlake.operators import manifest as N
from rasterlake.operators import metrics as M
from rasterlake.operators import raster as R
from rasterlake.plans import fixtures as V
from rasterlake.plans.fixtures import duck, duck_draw
from rasterlake.plans.registry import query, rounded

PX = ["image_id", "y", "x"]
KEYED = "(image_id * 1000003 + y * 1009 + x) % 999999937"
U = lambda key, salt: f"({duck_draw(key, salt)} / 2147483647.0::double)"


def raster(spark, sf):
    return V.raster(spark, sf)


query("s08_pack_unpack", duck("v_raster", "select image_id, y, x, gt label from v_raster"))(lambda s, d: R.unpack(R.pack(raster(s, d).withColumnRenamed("gt", "label"))).select(*PX, "label"))
TILE = {"tl": "select image_id, h, w, ty, tx, row_number() over (partition by image_id order by ty, tx) - 1 tile_id from (select *, unnest(range(0, w, 10)) tx from (select *, unnest(range(0, h, 10)) ty from v_image)) where least(16, h - ty) * least(16, w - tx) / 256.0::double >= 0.6"}
query("r02_tiles", duck("v_image", "select image_id, ty, tx, tile_id from tl", **TILE))(lambda s, d: R.tiles(V.images(s, d), 16, 10, 0.6).select("image_id", "ty", "tx", F.col("tile_id").cast("long").alias("tile_id")))
query("w04_dense_tile_index", duck("v_image", "select image_id, count(*) n, max(tile_id) last from tl group by image_id", **TILE))(lambda s, d: R.tiles(V.images(s, d), 16, 10, 0.6).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max("tile_id").cast("long").alias("last")))
query("r02_tile_pixels_reflect", duck("v_raster", """select t.image_id, t.tile_id, t.y, t.x, p.gt from (select *, case when (ty + y) % greatest(2 * (h - 1), 1) < h then (ty + y) % greatest(2 * (h - 1), 1) else greatest(2 * (h - 1), 1) - (ty + y) % greatest(2 * (h - 1), 1) end sy,
  case when (tx + x) % greatest(2 * (w - 1), 1) < w then (tx + x) % greatest(2 * (w - 1), 1) else greatest(2 * (w - 1), 1) - (tx + x) % greatest(2 * (w - 1), 1) end sx from (select *, unnest(range(16))::int x from (select *, unnest(range(16))::int y from tl))) t join v_raster p on p.image_id = t.image_id and p.y = sy and p.x = sx""", **TILE))(
    lambda s, d: R.tile_pixels(raster(s, d), R.tiles(V.images(s, d), 16, 10, 0.6), 16, ["gt"], "reflect").withColumn("tile_id", F.col("tile_id").cast("long")))
BIL = """with t as (select image_id, h, w, y, x, least(greatest((y + 0.5) * h / 18 - 0.5, 0), h - 1)::double fy, least(greatest((x + 0.5) * w / 50 - 0.5, 0), w - 1)::double fx from (select *, unnest(range(50)) x from (select *, unnest(range(18)) y from v_image))),
  f as (select *, floor(fy)::bigint y0, floor(fx)::bigint x0 from t), c as (select f.*, least(y0 + a, h - 1) sy, least(x0 + b, w - 1) sx, (case a when 1 then fy - y0 else 1 - fy + y0 end) * (case b when 1 then fx - x0 else 1 - fx + x0 end) k from f, (values (0), (1)) ta(a), (values (0), (1)) tb(b))
  select c.image_id, c.y, c.x, round(sum(k * p.r), 6) r from c join v_raster p on p.image_id = c.image_id and p.y = sy and p.x = sx group by all"""
query("r04_resize_bilinear", duck("v_raster", "select * from z", z=BIL))(lambda s, d: rounded(R.resize_bilinear(raster(s, d), V.images(s, d), F.lit(18), F.lit(50), ["r"])))
query("r05_resize_nearest", duck("v_raster", "select t.image_id, t.y, t.x, p.gt from (select *, unnest(range(50)) x from (select *, unnest(range(18)) y from v_image)) t join v_raster p on p.image_id = t.image_id and p.y = t.y * t.h // 18 and p.x = t.x * t.w // 50"))(lambda s, d: R.resize_nearest(raster(s, d), V.images(s, d), F.lit(18), F.lit(50), ["gt"]).select(*PX, "gt"))
query("r06_resize_policy", duck("v_image", f"select image_id, cast(floor(h * sc + 0.5) as bigint) nh, cast(floor(w * sc + 0.5) as bigint) nw from (select *, least(greatest(a, b)::double / greatest(h, w), least(a, b)::double / least(h, w)) sc from (select *, floor(({U('image_id', 3)} * 1.5 + 0.5) * 64) a, floor(({U('image_id', 3)} * 1.5 + 0.5) * 48) b from v_image))"))(
    lambda s, d: R.resize_policy(V.images(s, d), "ratio", [(64, 48)], (0.5, 2.0), salt=3).select("image_id", "nh", "nw"))
query("r07_resize_to_multiple", duck("v_image", "select image_id, cast(ceil(h / 20.0) as bigint) * 20 nh, cast(ceil(w / 20.0) as bigint) * 20 nw from v_image"))(lambda s, d: V.images(s, d).select("image_id", R.next_multiple(F.col("h"), 20).alias("nh"), R.next_multiple(F.col("w"), 20).alias("nw")))
query("r08_rescale_mask", duck("v_raster", "select t.image_id, t.y, t.x, p.gt from (select *, unnest(range(w // 2)) x from (select *, unnest(range(h // 2)) y from v_image)) t join v_raster p on p.image_id = t.image_id and p.y = t.y * t.h // (t.h // 2) and p.x = t.x * t.w // (t.w // 2)"))(lambda s, d: R.resize_nearest(raster(s, d), V.images(s, d), F.floor(F.col("h") / 2), F.floor(F.col("w") / 2), ["gt"]).select(*PX, "gt"))
query("r09_flip", duck("v_raster", f"select image_id, y, case when {U('image_id', 4)} < 0.5 then w - 1 - x else x end x, {U('image_id', 4)} < 0.5 flipped, gt from v_raster"))(lambda s, d: R.flip(raster(s, d), "horizontal", 0.5, 4).select(*PX, "flipped", "gt"))
query("r13_rotate90", duck("v_raster", "select image_id, w - 1 - x y, y x, gt from v_raster"))(lambda s, d: R.rotate90(raster(s, d)).select(*PX, "gt"))
query("r10_pad", duck("v_raster", "select t.image_id, t.y, t.x, coalesce(p.r, 0) r, coalesce(p.gt, 255) gt from (select *, unnest(range(44)) x from (select *, unnest(range(44)) y from v_image)) t left join v_raster p on p.image_id = t.image_id and p.y = t.y and p.x = t.x"))(lambda s, d: R.pad(raster(s, d), V.images(s, d), F.lit(44), F.lit(44), {"r": 0, "gt": 255}).select(*PX, "r", "gt"))
OFFS = f"select image_id, attempt, {duck_draw('(image_id * 64 + attempt)', 0)} % (greatest(h - 16, 0) + 1) oy, {duck_draw('(image_id * 64 + attempt)', 1)} % (greatest(w - 16, 0) + 1) ox from (select *, unnest(range(11)) attempt from v_image)"
query("r11_random_crop", duck("v_raster", "select c.image_id, c.y - c.oy y, c.x - c.ox x, c.gt from cells c join ch on c.image_id = ch.image_id and c.attempt = ch.attempt", offs=OFFS, cells="select p.*, attempt, oy, ox from v_raster p join offs o on p.image_id = o.image_id and p.y >= oy and p.y < oy + 16 and p.x >= ox and p.x < ox + 16",
    sh="select image_id, attempt, max(n)::double / sum(n) share, count(*) k from (select image_id, attempt, gt, count(*) n from cells where gt <> 255 group by all) group by all", ch="select i.image_id, coalesce(min(attempt), 10) attempt from v_image i left join (select * from sh where share < 0.75 and k > 1) s on i.image_id = s.image_id group by 1"))(lambda s, d: R.random_crop(raster(s, d), V.images(s, d), 16, 0.75).select(*PX, "gt"))
query("a30_region_label_share", duck("v_raster", "select image_id, y // 8 by_, x // 8 bx, max(n)::double / sum(n) share, count(*) n_classes from (select image_id, y // 8 yy, y, x, gt, 1 n from v_raster) group by all".replace("select image_id, y // 8 by_", "select image_id, by_").replace("x // 8 bx, max", "bx, max").replace("(select image_id, y // 8 yy, y, x, gt, 1 n from v_raster)", "(select image_id, y // 8 by_, x // 8 bx, gt, count(*) n from v_raster where gt <> 255 group by all)")))(
    lambda s, d: R.label_share(raster(s, d).withColumn("by_", F.floor(F.col("y") / 8)).withColumn("bx", F.floor(F.col("x") / 8)), ["image_id", "by_", "bx"]))
WARP = """select image_id, h, w, y, x, cast(floor(round((cos(radians({a})) * u - sin(radians({a})) * v) / {s}::double + (w - 1) / 2.0::double, 6) + 0.5) as bigint) sx, cast(floor(round((sin(radians({a})) * u + cos(radians({a})) * v) / {s}::double + (h - 1) / 2.0::double, 6) + 0.5) as bigint) sy
  from (select *, y - (h - 1) / 2.0::double - {dy} v, x - (w - 1) / 2.0::double - {dx} u from (select *, unnest(range(w)) x from (select *, unnest(range(h)) y from v_image)))"""
_mirror = lambda i, n: f"case when (({i} % (2 * ({n} - 1))) + 2 * ({n} - 1)) % (2 * ({n} - 1)) < {n} then (({i} % (2 * ({n} - 1))) + 2 * ({n} - 1)) % (2 * ({n} - 1)) else 2 * ({n} - 1) - (({i} % (2 * ({n} - 1))) + 2 * ({n} - 1)) % (2 * ({n} - 1)) end"
query("r12_rotate", duck("v_raster", "select t.image_id, t.y, t.x, coalesce(p.gt, 255) gt from warp t left join v_raster p on p.image_id = t.image_id and p.y = t.sy and p.x = t.sx", warp=WARP.format(a="10.0::double", s=1.0, dy=0.0, dx=0.0)))(lambda s, d: R.warp(raster(s, d), V.images(s, d), F.lit(10.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), {"gt": 255}).select(*PX, "gt"))
query("r14_shift_scale_rotate", duck("v_raster", f"select t.image_id, t.y, t.x, p.gt, p.r from warp t join v_raster p on p.image_id = t.image_id and p.y = {_mirror('t.sy', 't.h')} and p.x = {_mirror('t.sx', 't.w')}", warp=WARP.format(a="5.0::double", s=1.1, dy=1.0, dx=-2.0)))(lambda s, d: R.warp(raster(s, d), V.images(s, d), F.lit(5.0), F.lit(1.1), F.lit(1.0), F.lit(-2.0), {"gt": 255, "r": 0}, "reflect").select(*PX, "gt", "r"))
_TURN = """select image_id, h, w, y, x, round((cos(a) * u - sin(a) * v) + (w - 1) / 2.0::double, 6) fx, round((sin(a) * u + cos(a) * v) + (h - 1) / 2.0::double, 6) fy from
  (select *, y - (hh - h) / 2.0::double - (h - 1) / 2.0::double v, x - (ww - w) / 2.0::double - (w - 1) / 2.0::double u from (select *, unnest(range(cast(round_even(ww, 0) as bigint))) x from (select *, unnest(range(cast(round_even(hh, 0) as bigint))) y from
  (select *, round(h * abs(cos(a)) + w * abs(sin(a)), 6) hh, round(h * abs(sin(a)) + w * abs(cos(a)), 6) ww from (select *, radians(25.0::double) a from v_image)))))"""
_TURN_FOUR = "select image_id, y, x, floor(fy)::bigint + a sy, floor(fx)::bigint + b sx, (case a when 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * (case b when 1 then fx - floor(fx) else 1 - fx + floor(fx) end) k from turn, (values (0), (1)) ta(a), (values (0), (1)) tb(b)"
query("r12_rotate_whole_bilinear", duck("v_raster", "select c.image_id, c.y, c.x, cast(floor(round(sum(k * coalesce(p.r, 9)), 6) + 0.5) as int) r from four c left join v_raster p on p.image_id = c.image_id and p.y = c.sy and p.x = c.sx where k > 0 group by c.image_id, c.y, c.x", turn=_TURN, four=_TURN_FOUR))(
    lambda s, d: R.warp(raster(s, d), V.images(s, d), F.lit(25.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), {"r": 9}, bilinear=True, auto_bound=True).select(*PX, "r"))
query("r15_normalize", duck("v_raster", "select image_id, y, x, round((r - 123.675::double) / 58.395::double, 6) r, round((g - 116.28::double) / 57.12::double, 6) g, round((b - 103.53::double) / 57.375::double, 6) b from v_raster"))(lambda s, d: rounded(R.normalize(raster(s, d), (123.675, 116.28, 103.53), (58.395, 57.12, 57.375)).select(*PX, "r", "g", "b")))
query("r16_rerange", duck("v_raster", "select image_id, y, x, round((r - min(r) over w)::double / (max(r) over w - min(r) over w) * 255, 6) r from v_raster window w as (partition by image_id)"))(lambda s, d: rounded(R.rerange(raster(s, d), "r").select(*PX, "r")))
query("r17_clahe")(lambda s, d: rounded(R.clahe(R.to_gray(raster(s, d)), "gray", 2)))
query("r18_gray", duck("v_raster", "select image_id, y, x, round(r * 0.299::double + g * 0.587::double + b * 0.114::double, 6) gray from v_raster"))(lambda s, d: rounded(R.to_gray(raster(s, d)).select(*PX, "gray")))
query("r19_gamma", duck("v_raster", "select image_id, y, x, cast(trunc(pow(r / 255.0::double, 1.0::double / 2.2::double) * 255) as int) r from v_raster"))(lambda s, d: raster(s, d).select(*PX, R.gamma(F.col("r"), 2.2).alias("r")))
query("f07_uint8", duck("v_raster", "select image_id, y, x, cast(trunc(least(greatest(r * 1.3::double - 20, 0), 255)) as int) r from v_raster"))(lambda s, d: raster(s, d).select(*PX, uint8(F.col("r") * 1.3 - 20).alias("r")))
query("f06_hsv", duck("v_raster", """select image_id, y, x, cast(round_even((case when hue < 0 then hue + 360 else hue end) / 2, 0) as int) % 180 hh, cast(case when hi = 0 then 0 else round_even((hi - lo) * 255 / hi, 0) end as int) ss, cast(hi as int) vv from
  (select *, case when hi = lo then 0 when hi = r then 60 * (g - b) / (hi - lo) when hi = g then 120 + 60 * (b - r) / (hi - lo) else 240 + 60 * (r - g) / (hi - lo) end hue from (select *, greatest(r, g, b)::double hi, least(r, g, b)::double lo from v_raster))"""))(
    lambda s, d: raster(s, d).select(*PX, *[c.alias(n) for c, n in zip(hsv(F.col("r"), F.col("g"), F.col("b")), ("hh", "ss", "vv"), strict=True)]))


@query("f06_hsv_round_trip")
def hsv_round_trip(spark, sf):
    rows = raster(spark, sf).withColumns(dict(zip(("hh", "ss", "vv"), hsv(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    back = from_hsv(F.col("hh"), F.col("ss"), F.col("vv"))
    return rows.select(*PX, *[F.abs(F.col(c) - n).alias("d" + c) for c, n in zip("rgb", back, strict=True)]).groupBy("image_id").agg(F.max(F.greatest("dr", "dg", "db")).alias("most"))


query("f12_scale_to_unit", duck("v_raster", "select image_id, y, x, round(r / 255.0::double, 6) r from v_raster"))(lambda s, d: rounded(raster(s, d).select(*PX, (F.col("r") / 255.0).alias("r"))))
query("f08_grid_math", duck("v_image", "select image_id, (14 - h % 14) % 14 pad_h, greatest(h - 20 + 11, 0) // 12 + 1 n_rows from v_image"))(lambda s, d: V.images(s, d).select("image_id", padding(F.col("h"), 14).alias("pad_h"), n_windows(F.col("h"), 20, 12).alias("n_rows")))
query("f10_percent_half_even", duck("v_raster", "select image_id, round_even(sum(case when gt = pred then 1 else 0 end)::double / count(*) * 100, 2) / 100 acc from v_raster group by image_id"))(lambda s, d: raster(s, d).groupBy("image_id").agg(percent(F.sum((F.col("gt") == F.col("pred")).cast("int")).cast("double") / F.count(F.lit(1))).alias("acc")))
query("r20_photometric")(lambda s, d: R.photometric(raster(s, d), 11).select(*PX, "r", "g", "b"))
query("r21_rgb_shift", duck("v_raster", f"select image_id, y, x, {', '.join(f'cast(least(greatest({c} + cast(floor({U('image_id', 20 + i)} * 41) as bigint) - 20, 0), 255) as int) {c}' for i, c in enumerate('rgb'))} from v_raster"))(lambda s, d: R.rgb_shift(raster(s, d), (20, 20, 20), 20).select(*PX, "r", "g", "b"))
query("r21_hue_sat_value")(lambda s, d: R.hue_saturation_value(raster(s, d), (10, 20, 20), 30).select(*PX, "r", "g", "b"))
NOISE = {
    "k": f"select *, {KEYED} k0 from v_raster",
    "d": f"select *, {', '.join(f'({duck_draw("k0", 40 + 2 * i)} + 1) / 2147483648.0::double a{i}, {U("k0", 41 + 2 * i)} b{i}' for i in range(3))} from k",
}
query("r21_gauss_noise", duck("v_raster", f"select image_id, y, x, {', '.join(f'cast(trunc(least(greatest({c} + sqrt(-2 * ln(a{i})) * cos(6.283185307179586::double * b{i}) * 5.0::double, 0), 255)) as int) {c}' for i, c in enumerate('rgb'))} from d", **NOISE))(lambda s, d: R.gauss_noise(raster(s, d), 5.0, 40).select(*PX, "r", "g", "b"))
query("r21_box_blur", duck("v_raster", "select p.image_id, p.y, p.x, round(avg(q.r), 6) r from v_raster p join v_raster q on q.image_id = p.image_id and q.y between p.y - 1 and p.y + 1 and q.x between p.x - 1 and p.x + 1 group by all"))(lambda s, d: rounded(R.box_blur(raster(s, d), 1, ["r"]).select(*PX, "r")))
query("r21_brightness_contrast", duck("v_raster", "select image_id, y, x, cast(trunc(least(greatest(r * 1.2::double + 15, 0), 255)) as int) r from v_raster"))(lambda s, d: raster(s, d).select(*PX, R.brightness_contrast(F.col("r"), F.lit(15.0), F.lit(1.2)).alias("r")))
_hole = " or ".join(f"(y >= {duck_draw('image_id', 50 + 2 * i)} % h and y < {duck_draw('image_id', 50 + 2 * i)} % h + 6 and x >= {duck_draw('image_id', 51 + 2 * i)} % w and x < {duck_draw('image_id', 51 + 2 * i)} % w + 6)" for i in range(3))
query("r22_cutout", duck("v_raster", f"select image_id, y, x, case when {_hole} then 0 else r end r, case when {_hole} then 255 else gt end gt from v_raster"))(lambda s, d: R.cutout(raster(s, d), 3, 6, {"r": 0, "gt": 255}, 50).select(*PX, "r", "gt"))


def partners(spark, sf, salt=60):
    ims = V.images(spark, sf)
    return N.partner_pairing(ims.withColumn("idx", F.col("image_id")), ims.count(), salt)


PAIR = {
    "pr_n": "select count(*) n from v_image",
    "pr_d": f"select image_id, (image_id + 1 + {duck_draw('image_id', 60)} % greatest(n - 1, 1)) % n pi from v_image, pr_n",
    "pr": "select a.image_id, b.image_id partner_id from pr_d a join v_image b on b.image_id = a.pi",
}
query("j08_partner_pairing", duck("v_image", "select * from pr", **PAIR))(lambda s, d: partners(s, d).select("image_id", "partner_id"))
BETA = lambda u, alpha: f"([{', '.join(f'{q}::double' for q in R.beta_quantiles(alpha))}])[cast(floor({u} * {R.BETA_STEPS}) as int) + 1]"


def with_partner_sql(source: str = "v_raster") -> dict[str, str]:
    """Each pixel beside its partner's, by equality joins of tables that are made first."""
    return {
        "mine": f"select p.*, pr.partner_id from {source} p join pr on p.image_id = pr.image_id",
        "two": "select m.*, coalesce(q.r, m.r) qr, coalesce(q.gt, m.gt) qgt from mine m left join v_raster q on q.image_id = m.partner_id and q.y = m.y and q.x = m.x",
    }


def mixed_sql(salt: int, alpha: float) -> dict[str, str]:
    """`mixed`: pixels of `two` blended by a weight a pixel."""
    return {
        "u1": f"select *, {KEYED} k0 from two",
        "u2": f"select *, {U('k0', salt)} u from u1",
        "u3": f"select *, {BETA('u', alpha)} lam from u2",
        "mixed": "select image_id, y, x, cast(floor(round(lam * r + (1 - lam) * qr, 6)) as int) r, case when lam >= 0.5 then gt else qgt end gt from u3",
    }


query("r23_mixup", duck("v_image v_raster", "select image_id, y, x, r, gt from mixed", **PAIR, **with_partner_sql(), **mixed_sql(70, 0.3)))(lambda s, d: R.mixup(raster(s, d), partners(s, d), 0.3, 70).select(*PX, "r", "gt"))
query("r24_cutmix", duck("v_image v_raster", "select image_id, y, x, case when y >= greatest(cy - bh // 2, 0) and y < least(cy + bh // 2, h) and x >= greatest(cx - bw // 2, 0) and x < least(cx + bw // 2, w) then qgt else gt end gt from two join box using (image_id)", **PAIR, **with_partner_sql(),
    ratio=f"select image_id, h bh0, w bw0, {U('image_id', 80)} u, {duck_draw('image_id', 81)} % h cy, {duck_draw('image_id', 82)} % w cx from v_image",
    box=f"select image_id, cy, cx, cast(floor(bh0 * sqrt(1 - lam)) as bigint) bh, cast(floor(bw0 * sqrt(1 - lam)) as bigint) bw from (select *, {BETA('u', 0.8)} lam from ratio)"))(lambda s, d: R.cutmix(raster(s, d), partners(s, d), 0.8, 80).select(*PX, "gt"))


def pair_sql(name: str, salt: int) -> dict[str, str]:
    """`{name}`: each image and its drawn partner."""
    return {
        f"{name}_n": "select count(*) n from v_image",
        f"{name}_d": f"select image_id, (image_id + 1 + {duck_draw('image_id', salt)} % greatest(n - 1, 1)) % n pi from v_image, {name}_n",
        name: f"select a.image_id, b.image_id partner_id from {name}_d a join v_image b on b.image_id = a.pi",
    }


MOSAIC = {
    **pair_sql("pa", 91), **pair_sql("pb", 92), **pair_sql("pc", 93),
    "quads": "select image_id, 0 quadrant, image_id source_id from v_image union all select image_id, 1, partner_id from pa union all select image_id, 2, partner_id from pb union all select image_id, 3, partner_id from pc",
    "fit": "select image_id, h, w, cast(floor(round(h * sc, 6)) as bigint) nh, cast(floor(round(w * sc, 6)) as bigint) nw from (select *, least(24.0::double / h, 24.0::double / w) sc from v_image)",
    "t": "select *, least(greatest((y + 0.5) * h / nh - 0.5, 0), h - 1)::double fy, least(greatest((x + 0.5) * w / nw - 0.5, 0), w - 1)::double fx from (select *, unnest(range(nw)) x from (select *, unnest(range(nh)) y from fit))",
    "c": "select image_id, y, x, least(floor(fy)::bigint + a, h - 1) sy, least(floor(fx)::bigint + b, w - 1) sx, (case a when 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * (case b when 1 then fx - floor(fx) else 1 - fx + floor(fx) end) k from t, (values (0), (1)) ta(a), (values (0), (1)) tb(b)",
    "col": "select c.image_id, c.y, c.x, cast(floor(round(sum(k * p.r), 6) + 0.5) as int) r from c join v_raster p on p.image_id = c.image_id and p.y = c.sy and p.x = c.sx group by c.image_id, c.y, c.x",
    "near": "select image_id source_id, y sy, x sx, y * h // nh oy, x * w // nw ox, nh, nw from t",
    "lab": "select n.source_id, n.sy, n.sx, n.nh, n.nw, p.gt from near n join v_raster p on p.image_id = n.source_id and p.y = n.oy and p.x = n.ox",
    "src": "select l.*, col.r from lab l join col on col.image_id = l.source_id and col.y = l.sy and col.x = l.sx",
    "spot": f"select image_id, quadrant, source_id, cast(floor(({U('image_id', 95)} + 0.5) * 24) as bigint) cy, cast(floor(({U('image_id', 96)} + 0.5) * 24) as bigint) cx from quads",
    "put": "select a.image_id, case when quadrant < 2 then cy - nh + sy else cy + sy end y, case when quadrant % 2 = 0 then cx - nw + sx else cx + sx end x, s.r, s.gt from spot a join src s on s.source_id = a.source_id",
    "canvas": "select *, unnest(range(48)) x from (select image_id, unnest(range(48)) y from v_image)",
}


@query("r25_mosaic", duck("v_image v_raster", "select c.image_id, c.y, c.x, coalesce(p.r, 0) r, coalesce(p.gt, 255) gt from canvas c left join put p on p.image_id = c.image_id and p.y = c.y and p.x = c.x", **MOSAIC))
def mosaic(spark, sf):
    own = V.images(spark, sf).select("image_id", F.lit(0).alias("quadrant"), F.col("image_id").alias("source_id"))
    for q in (1, 2, 3):
        own = own.unionByName(partners(spark, sf, 90 + q).select("image_id", F.lit(q).alias("quadrant"), F.col("partner_id").alias("source_id")))
    return R.mosaic(raster(spark, sf), V.images(spark, sf), own, 24, salt=95).select(*PX, "r", "gt")


@query("r26_mix_pipeline", duck("v_image v_raster", "select image_id, y, x, r, gt from mixed", flipped="select image_id, h, w, y, w - 1 - x x, gt, r from v_raster", **PAIR, **with_partner_sql("flipped"), **mixed_sql(70, 0.3)))
def mix_pipeline(spark, sf):
    """Samples flipped, then mixed with drawn ones of the dataset; a third step is skipped by its name."""
    steps = [("flip", _flip_all, 0), ("mixup", lambda df, drawn, others: R.mixup(df, drawn, 0.3, 70, others), 1), ("blank", _blank, 0)]
    return R.mix_pipeline(raster(spark, sf), steps, lambda salt: partners(spark, sf, 60 + salt), {"blank"}).select(*PX, "r", "gt")


query("r27_compose", duck("v_raster", "select image_id, y, w - 1 - x x, 0 gt from v_raster where gt <> 255"))(lambda s, d: R.compose(raster(s, d), [_flip_all, _drop_ignored, _blank]).select(*PX, "gt"))


def _flip_all(df):
    return R.flip(df)


def _drop_ignored(df):
    return df.where("gt <> 255")


def _blank(df):
    return df.withColumn("gt", F.lit(0))


query("r28_format_tensor", duck("v_raster", "select image_id, 0 channel, y, x, r::double as value from v_raster union all select image_id, 1, y, x, g from v_raster union all select image_id, 2, y, x, b from v_raster"))(lambda s, d: R.channels_first(raster(s, d)))
query("u07_tta_views", duck("v_image", "select image_id, scale, flip, direction from v_image, (values (0.5::double), (1.0)) a(scale), (values (false, 'horizontal'), (true, 'horizontal'), (true, 'vertical')) b(flip, direction)"))(lambda s, d: N.tta_views(V.images(s, d), [0.5, 1.0], [False, True], ["horizontal", "vertical"]).select("image_id", "scale", "flip", "direction"))


@query("a28_tta_merge", duck("v_raster", "select image_id, y, x, 0 class_id, round((r + r + 3) / 2.0::double, 6) score from v_raster"))
def tta_merge(spark, sf):
    a = raster(spark, sf).select("image_id", "h", "w", "y", "x", F.lit(0).alias("class_id"), F.col("r").cast("double").alias("score"), F.lit(False).alias("flip"), F.lit("horizontal").alias("direction"))
    b = a.withColumn("x", F.col("w") - 1 - F.col("x")).withColumn("score", F.col("score") + 3).withColumn("flip", F.lit(True))
    return rounded(G.tta_merge(a.unionByName(b)))


query("w05_boundary_mask", duck("v_raster", "select a.image_id, a.gt as label, a.y, a.x from v_raster a left join v_raster b on b.image_id = a.image_id and b.gt = a.gt and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by all having count(*) < 9"))(lambda s, d: M.boundary_mask(raster(s, d).select("image_id", "y", "x", F.col("gt").alias("label")), 1))
