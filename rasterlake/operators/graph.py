"""Vectors and graphs: zero-shot scores, k nearest neighbours, affinities, label propagation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.functions.scalars import affinity, clamp_power, dot, lab, norm, normalise, squared_distance
from rasterlake.operators.propagation import propagate, refine_pixels
from rasterlake.sources.scratch import stage

#: Tile edge of the pixel graph, in pixels.
TILE = 64


def zero_shot_scores(patches: DataFrame, classes: DataFrame, keys: list[str], temperature: float | None = None) -> DataFrame:
    """The cosine of each vector with each class vector; with a temperature, the softmax over classes.

    All class vectors are one row, a list, so that the join repeats no patch and Spark chooses by
    the list's size whether to broadcast it.
    """
    listed = classes.agg(F.collect_list(F.struct("class_id", "class_feat")).alias("__classes"))
    rows = patches.join(listed).select("*", F.inline("__classes")).select(*keys, "class_id", dot(F.col("feat"), F.col("class_feat")).alias("score"))
    if temperature is None:
        return rows
    w = W.Window.partitionBy(*keys)
    e = F.exp((F.col("score") - F.max("score").over(w)) * temperature)
    return rows.withColumn("__e", e).withColumn("score", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def prompt_mean(prompts: DataFrame, keys: list[str], feat: str = "feat") -> DataFrame:
    """Prompt vectors made unit vectors, averaged, and made unit vectors again."""
    rows = prompts.select(*keys, F.posexplode(normalise(F.col(feat))).alias("d", "v")).groupBy(*keys, "d").agg(F.avg("v").alias("v"))
    return rows.groupBy(*keys).agg(normalise(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda s: s["v"])).alias(feat))


def _within(block_size: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, a = right["node"].to_numpy(), np.array(right["feat"].to_pylist(), float)
        out = []
        for i in range(0, left.num_rows, block_size):
            part = left.slice(i, block_size)
            sims = np.array(part["feat"].to_pylist(), float) @ a.T
            order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
            src = np.repeat(part["node"].to_numpy(), order.shape[1])
            group = pa.array(np.repeat(part["graph_id"].to_numpy(), order.shape[1]))
            out.append(pa.table({"graph_id": group, "src": pa.array(src), "dst": pa.array(ids[order].ravel()), "sim": pa.array(np.take_along_axis(sims, order, 1).ravel())}))
        return pa.concat_tables(out)

    return run


def knn_join(vectors: DataFrame, k: int, block_size: int = 1024) -> DataFrame:
    """The k vectors of largest inner product in each vector's graph, itself included, ties by node.

    `vectors` has graph_id, node, feat. A graph's nodes fall into blocks of about `block_size`, as
    many as its own size asks for; each pair of blocks is one task's matrix product that keeps k a
    row, and the k best of all blocks are ranked at the end. No task holds more than two blocks,
    whatever the graph's size, and a small graph is not repeated because another one is large.
    """
    sizes = vectors.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("blocks"))
    rows = vectors.select("graph_id", "node", "feat").join(sizes, "graph_id").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    same = [F.col(c).alias(c) for c in ("graph_id", "node", "feat")]  # columns of its own for each side
    left = rows.withColumn("o", every).select(F.col("b").alias("l"), F.col("o").alias("r"), *same)
    right = rows.withColumn("o", every).select(F.col("o").alias("l"), F.col("b").alias("r"), *same)
    run = _within(256, k)

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return run(a, b)
        return pa.table({"graph_id": pa.array([], pa.int64()), "src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})

    near = left.groupBy("graph_id", "l", "r").cogroup(right.groupBy("graph_id", "l", "r")).applyInArrow(one, "graph_id long, src long, dst long, sim double")
    rank = F.row_number().over(W.Window.partitionBy("graph_id", "src").orderBy(F.desc("sim"), "dst"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(table: pa.Table) -> np.ndarray:
    return np.array(table["feat"].to_pylist(), float).reshape(table.num_rows, -1)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, ties by id; `ids` ascend."""
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def knn_join_pruned(vectors: DataFrame, k: int, block_size: int = 1024) -> tuple[DataFrame, DataFrame]:
    """`knn_join` for large graphs of grouped vectors, and a report: `graph_id, pairs, skipped` of blocks.

    A graph's nodes go to the nearest of some of its nodes (those of least hash, one for each
    `block_size` nodes), and groups above that size are split, so that a block lies close together.
    Each block is multiplied with itself first. Its centre c and radius r bound the products of two
    blocks by c1.c2 + |c1| r2 + |c2| r1 + r1 r2, and blocks are multiplied only where that reaches the
    least k-th best that a node of the first one has so far. The result is that of `knn_join`, exactly.
    """
    vectors = vectors.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("node").cast("long").alias("node"), "feat")
    sizes = vectors.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("blocks"))
    rows = vectors.join(sizes, "graph_id").withColumn("h", F.xxhash64("node")).withColumn("dealt", F.pmod(F.col("h"), F.col("blocks")).cast("int"))
    nth = F.row_number().over(W.Window.partitionBy("graph_id").orderBy("h", "node"))
    seeds = rows.withColumn("nth", nth).where(F.col("nth") <= F.col("blocks")).select("graph_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("dealt"), F.col("nth").alias("group"), F.col("feat").alias("centre"))

    def assign(part: pa.Table, centres: pa.Table) -> pa.Table:
        if not part.num_rows:
            return part.select(["graph_id", "node"]).append_column("group", pa.array([], pa.int32())).append_column("feat", part["feat"])
        x, c = _matrix(part), np.array(centres["centre"].to_pylist(), float)
        order = np.argsort(centres["group"].to_numpy(), kind="stable")
        c, names = c[order], centres["group"].to_numpy()[order]
        near = np.concatenate([((c * c).sum(axis=1) - 2 * x[i : i + 512] @ c.T).argmin(axis=1) for i in range(0, len(x), 512)])
        return pa.table({"graph_id": part["graph_id"], "node": part["node"], "group": pa.array(names[near].astype(np.int32)), "feat": part["feat"]})

    mine = rows.select("graph_id", "node", "feat", "dealt")
    placed = mine.groupBy("graph_id", "dealt").cogroup(seeds.select(*[F.col(c).alias(c) for c in seeds.columns]).groupBy("graph_id", "dealt")).applyInArrow(assign, "graph_id long, node long, group int, feat array<double>")
    placed = stage(placed, "groups")
    split = placed.groupBy("graph_id", "group").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("pieces"))
    placed = placed.join(split, ["graph_id", "group"]).withColumn("block", (F.col("group").cast("long") * (1 << 31) + F.pmod(F.xxhash64("node"), F.col("pieces"))).cast("long"))
    placed = stage(placed.select("graph_id", "block", "node", "feat"), "blocks")

    def within(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        x, ids = _matrix(part), part["node"].to_numpy()
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-12
        src, dst, sim, least = [], [], [], np.inf
        for i in range(0, len(x), 256):
            sims = x[i : i + 256] @ x.T
            best = _best(sims, ids, k)
            values = np.take_along_axis(sims, best, 1)
            src.append(np.repeat(ids[i : i + 256], best.shape[1]))
            dst.append(ids[best].ravel())
            sim.append(values.ravel())
            least = min(least, values[:, -1].min()) if best.shape[1] == k else -np.inf
        lists = {"src": (src, pa.int64()), "dst": (dst, pa.int64()), "sim": (sim, pa.float64())}
        return pa.table({"graph_id": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()]), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "least": pa.array([float(least)]), **{c: pa.array([np.concatenate(v)], pa.list_(t)) for c, (v, t) in lists.items()}})

    own = stage(placed.groupBy("graph_id", "block").applyInArrow(within, "graph_id long, block long, centre array<double>, radius double, least double, src array<long>, dst array<long>, sim array<double>"), "within")
    a, b = (own.select("graph_id", F.col("block").alias(f"{s}"), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}"), F.col("least").alias(f"least{s}")) for s in ("l", "r"))
    bound = dot(F.col("cl"), F.col("cr")) + norm(F.col("cl")) * F.col("rr") + norm(F.col("cr")) * F.col("rl") + F.col("rl") * F.col("rr")
    pairs = stage(a.join(b, "graph_id").where("l <> r").select("graph_id", "l", "r", (bound * (1 + 1e-9) + 1e-9 >= F.col("leastl")).alias("needed")), "pairs")
    report = pairs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.when(F.col("needed"), 0).otherwise(1)).alias("skipped"))
    needed = pairs.where("needed").select("graph_id", "l", "r")
    left = placed.withColumnRenamed("block", "l").join(needed, ["graph_id", "l"])
    right = placed.select("graph_id", F.col("block").alias("r"), "node", "feat").join(needed, ["graph_id", "r"])
    right = right.select(*[F.col(c).alias(c) for c in ("graph_id", "l", "r", "node", "feat")])

    def across(x: pa.Table, y: pa.Table) -> pa.Table:
        out = {"graph_id": pa.array([], pa.int64()), "src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())}
        if x.num_rows and y.num_rows:
            y = y.sort_by("node")
            m, other, ids, nodes = _matrix(x), _matrix(y), y["node"].to_numpy(), x["node"].to_numpy()
            parts = []
            for i in range(0, len(m), 256):
                sims = m[i : i + 256] @ other.T
                best = _best(sims, ids, k)
                parts.append((np.repeat(nodes[i : i + 256], best.shape[1]), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()))
            src, dst, sim = (np.concatenate(v) for v in zip(*parts, strict=True))
            out = {"graph_id": pa.array(np.full(len(src), x["graph_id"][0].as_py())), "src": pa.array(src), "dst": pa.array(dst), "sim": pa.array(sim)}
        return pa.table(out)

    far = left.groupBy("graph_id", "l", "r").cogroup(right.groupBy("graph_id", "l", "r")).applyInArrow(across, "graph_id long, src long, dst long, sim double")
    near = own.select("graph_id", F.inline(F.arrays_zip("src", "dst", "sim")))
    rank = F.row_number().over(W.Window.partitionBy("graph_id", "src").orderBy(F.desc("sim"), "dst"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k), report


def knn_join_plain(vectors: DataFrame, k: int) -> DataFrame:
    """`knn_join` as one join and rank; for graphs of some hundred nodes."""
    a = vectors.select("graph_id", F.col("node").alias("src"), F.col("feat").alias("fa"))
    b = vectors.select("graph_id", F.col("node").alias("dst"), F.col("feat").alias("fb"))
    pairs = a.join(b, "graph_id").select("graph_id", "src", "dst", dot(F.col("fa"), F.col("fb")).alias("sim"))
    rank = F.row_number().over(W.Window.partitionBy("graph_id", "src").orderBy(F.desc("sim"), "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def patch_centers(df: DataFrame, size: int, y1: Column | None = None, x1: Column | None = None) -> DataFrame:
    zero = F.lit(0)
    return df.withColumn("cy", (y1 if y1 is not None else zero) + size // 2 + F.col("py") * size).withColumn("cx", (x1 if x1 is not None else zero) + size // 2 + F.col("px") * size)


def knn_affinity(neighbours: DataFrame, centers: DataFrame, gamma: float, sigma: float, power: float = 1.0) -> DataFrame:
    """Edges of the k neighbours: similarity clamped at 0, to the power gamma, times exp(-sigma distance^power) of the centres."""
    c = centers.select("graph_id", F.col("node").alias("src"), F.col("cy").alias("y1"), F.col("cx").alias("x1"))
    d = centers.select("graph_id", F.col("node").alias("dst"), F.col("cy").alias("y2"), F.col("cx").alias("x2"))
    rows = neighbours.join(c, ["graph_id", "src"]).join(d, ["graph_id", "dst"])
    dist = F.sqrt((F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")) + (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")))
    return rows.select("graph_id", "src", "dst", (clamp_power(F.col("sim"), gamma) * affinity(dist, sigma, power)).alias("w"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """W + W^T."""
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("graph_id", "src", "dst", "w").unionByName(back).groupBy("graph_id", "src", "dst").agg(F.sum("w").alias("w"))


def normalize_graph(edges: DataFrame) -> DataFrame:
    """Without the diagonal, each weight over the root of both ends' degrees."""
    off = edges.where("src <> dst")
    degree = off.groupBy("graph_id", "src").agg(F.sum("w").alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    out = off.join(degree, ["graph_id", "src"]).withColumnRenamed("s", "s1")
    out = out.join(degree.select("graph_id", F.col("src").alias("dst"), F.col("s").alias("s2")), ["graph_id", "dst"])
    return out.select("graph_id", "src", "dst", (F.col("w") / F.sqrt(F.col("s1")) / F.sqrt(F.col("s2"))).alias("w"))


def pixel_grid_edges(pixels: DataFrame, neigh: int, tau: float) -> DataFrame:
    """Edges to all pixels within `neigh` steps, by likeness of colour; both directions, no loops. A node is y * 100000 + x.

    Images are dealt to tiles, each with a rim of `neigh` pixels of its neighbours, and a task
    compares a tile's own pixels with shifted views of it: what moves is the pixels and their rims,
    not a row for each pixel and offset.
    """
    l, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    rows = pixels.select(F.col("image_id").cast("long").alias("graph_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), l.alias("l"), a.alias("a"), b.alias("b"))
    tiles = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - neigh) / TILE), F.lit(0)), F.floor((F.col(c) + neigh) / TILE))
    rows = rows.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x")))

    def compare(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        y0, x0 = table["ty"][0].as_py() * TILE, table["tx"][0].as_py() * TILE
        side = TILE + 2 * neigh
        lab_ = np.full((side + 2 * neigh, side + 2 * neigh, 3), np.nan)  # NaN where there is no pixel
        at = y - y0 + 2 * neigh, x - x0 + 2 * neigh
        lab_[at] = np.stack([table[c].to_numpy() for c in ("l", "a", "b")], axis=1)
        own = (y >= y0) & (y < y0 + TILE) & (x >= x0) & (x < x0 + TILE)
        y, x, at = y[own], x[own], (at[0][own], at[1][own])
        src, dst, w = [], [], []
        for dy in range(-neigh, neigh + 1):
            for dx in range(-neigh, neigh + 1):
                if dy or dx:
                    d = np.sqrt(((lab_[at] - lab_[at[0] + dy, at[1] + dx]) ** 2).sum(axis=1))
                    ok = ~np.isnan(d)
                    src.append((y * 100000 + x)[ok])
                    dst.append(((y + dy) * 100000 + x + dx)[ok])
                    w.append(np.exp(-d[ok] / tau))
        n = sum(map(len, src))
        return pa.table({"graph_id": pa.array(np.full(n, table["graph_id"][0].as_py()), pa.int64()), "src": np.concatenate(src), "dst": np.concatenate(dst), "w": np.concatenate(w)})

    return rows.groupBy("graph_id", "ty", "tx").applyInArrow(compare, "graph_id long, src long, dst long, w double")


def laplacian(x: DataFrame, edges: DataFrame, alpha: float, value: str = "x") -> DataFrame:
    """x - alpha W x by graph, node and class; nodes without edges keep x."""
    moved = edges.join(x.select("graph_id", F.col("node").alias("dst"), "class_id", F.col(value).alias("__v")), ["graph_id", "dst"])
    summed = moved.groupBy("graph_id", F.col("src").alias("node"), "class_id").agg(F.sum(F.col("w") * F.col("__v")).alias("__s"))
    return x.join(summed, ["graph_id", "node", "class_id"], "left").withColumn("lx", F.col(value) - alpha * F.coalesce("__s", F.lit(0.0))).drop("__s")


def propagate_in_groups(edges: DataFrame, start: DataFrame, alpha: float = 0.95, iterations: int = 10, tol: float = 1e-6) -> DataFrame:
    """`propagate` with one task a graph: for many graphs of at most some thousand nodes each."""

    def solve(e: pa.Table, s: pa.Table) -> pa.Table:
        nodes, at = np.unique(s["node"].to_numpy(), return_inverse=True)
        classes, c = np.unique(s["class_id"].to_numpy(), return_inverse=True)
        y = np.zeros((len(nodes), len(classes)))
        y[at, c] = s["y"].to_numpy()
        src, dst = np.searchsorted(nodes, e["src"].to_numpy()), np.searchsorted(nodes, e["dst"].to_numpy())
        w = e["w"].to_numpy()[:, None]
        x, r, p = np.zeros_like(y), y.copy(), y.copy()
        limit = (y * y).sum(0) * tol * tol
        for _ in range(iterations):
            q = p.copy()
            np.subtract.at(q, src, alpha * w * p[dst])
            rho, pq = (r * r).sum(0), (p * q).sum(0)
            a = np.where((rho <= limit) | (pq == 0), 0.0, rho / np.where(pq == 0, 1.0, pq))
            x += a * p
            r -= a * q
            p = r + np.where(rho == 0, 0.0, (r * r).sum(0) / np.where(rho == 0, 1.0, rho)) * p
        return pa.table({"graph_id": s["graph_id"], "node": s["node"], "class_id": s["class_id"], "x": pa.array(x[at, c])})

    return edges.groupBy("graph_id").cogroup(start.select("graph_id", "node", "class_id", "y").groupBy("graph_id")).applyInArrow(solve, "graph_id long, node long, class_id int, x double")


def soft_codebook(vectors: DataFrame, codebook: DataFrame, key: str = "image_id", scale: float = -1.0) -> DataFrame:
    """Residuals to codewords, weighted by the softmax of scale * squared distance, summed by image, code and dimension."""
    listed = codebook.agg(F.collect_list(F.struct("code_id", "code_feat")).alias("__codes"))  # one row
    rows = vectors.join(listed).select("*", F.inline("__codes")).drop("__codes").withColumn("s", scale * squared_distance(F.col("feat"), F.col("code_feat")))
    w = W.Window.partitionBy(key, "node")
    rows = rows.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("a", F.col("e") / F.sum("e").over(w))
    parts = rows.select(key, "code_id", F.posexplode(F.zip_with(F.col("feat"), F.col("code_feat"), lambda x, c: F.col("a") * (x - c))).alias("d", "v"))
    return parts.groupBy(key, "code_id", "d").agg(F.sum("v").alias("v"))


def saliency(vectors: DataFrame, classes: DataFrame, key: str = "image_id") -> DataFrame:
    """relu(feat . class), scaled to 0..1 within image and class."""
    w = W.Window.partitionBy(key, "class_id")
    rows = zero_shot_scores(vectors, classes, [key, "node"]).withColumn("score", F.greatest("score", F.lit(0.0)))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return rows.withColumn("saliency", F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(0.0))).drop("score")


def fuse(base: Column, mixed: Column, how: str) -> Column:
    if how not in ("add", "replace", "concat"):
        raise ValueError(f"unknown fusion {how}")
    return mixed if how == "replace" else (base + mixed) / 2


def synonym_max(scores: DataFrame, keys: list[str], n_background: int) -> DataFrame:
    """The first `n_background` expanded columns become class 0 by their maximum; the others move down."""
    c = F.greatest(F.col("class_id") - (n_background - 1), F.lit(0))
    return scores.groupBy(*keys, c.alias("class_id")).agg(F.max("score").alias("score"))


def windows(images: DataFrame, crop: int, stride: int) -> DataFrame:
    """Sliding windows, the last ones moved back into the image."""

    def starts(size: str, lo: str, hi: str) -> tuple[Column, Column]:
        i = F.col(lo) * stride
        end = F.least(i + crop, F.col(size))
        return F.greatest(end - crop, F.lit(0)).alias(lo), end.alias(hi)

    n = lambda s: F.floor(F.greatest(F.col(s) - crop + stride - 1, F.lit(0)) / stride)
    rows = images.withColumn("y1", F.explode(F.sequence(F.lit(0).cast("long"), n("h")))).withColumn("x1", F.explode(F.sequence(F.lit(0).cast("long"), n("w"))))
    ident = (F.col("y1") * (n("w") + 1) + F.col("x1")).alias("window_id")
    return rows.select("image_id", "h", "w", ident, *starts("h", "y1", "y2"), *starts("w", "x1", "x2"))


def window_pixels(wins: DataFrame) -> DataFrame:
    """The pixels of each window."""
    return wins.withColumn("y", F.explode(F.sequence("y1", F.col("y2") - 1))).withColumn("x", F.explode(F.sequence("x1", F.col("x2") - 1)))


def covering_windows(pixels: DataFrame, crop: int, stride: int) -> DataFrame:
    """Each pixel (with its image's h and w) once for each of its windows: `window_id`, and `wy`, `wx` within the window.

    The windows that cover a row or column follow from its number by arithmetic alone: those between
    the first and last that start at multiples of the stride and reach it, and the last one, which is
    moved back into the image.
    """
    rows = pixels
    for i, size, k, start in (("y", "h", "__v", "wy"), ("x", "w", "__u", "wx")):
        at, edge = F.col(i), F.col(size)
        last = F.floor(F.greatest(edge - crop + stride - 1, F.lit(0)) / stride)
        final = F.greatest(edge - crop, F.lit(0))  # where the last one starts
        low = F.greatest(F.floor((at - crop) / stride) + 1, F.lit(0))
        high = F.when(at >= final, last).otherwise(F.least(F.floor(at / stride), last - 1))
        rows = rows.withColumn(k, F.explode(F.when(low <= high, F.sequence(low, high))))
        rows = rows.withColumn(start, at - F.when(F.col(k) == last, final).otherwise(F.col(k) * stride))
    n_columns = F.floor(F.greatest(F.col("w") - crop + stride - 1, F.lit(0)) / stride) + 1
    return rows.withColumn("window_id", F.col("__v") * n_columns + F.col("__u")).drop("__v", "__u")


def overlap_merge(scores: DataFrame, keys: tuple[str, ...] = ("image_id", "y", "x", "class_id")) -> DataFrame:
    """The mean of the scores that overlapping windows give a pixel."""
    return scores.groupBy(*keys).agg((F.sum("score") / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("n_windows"))


def uncovered(images_pixels: DataFrame, merged: DataFrame) -> DataFrame:
    return images_pixels.join(merged.select("image_id", "y", "x").distinct(), ["image_id", "y", "x"], "left_anti")


def node_ids(df: DataFrame, graph: str = "graph_id", order: tuple[str, ...] = ("window_id", "py", "px")) -> DataFrame:
    """Windows of an image as one node set: node numbers from 0 in window order."""
    return df.withColumn("node", (F.row_number().over(W.Window.partitionBy(graph).orderBy(*order)) - 1).cast("long"))


def tta_merge(views: DataFrame, keys: tuple[str, ...] = ("image_id", "y", "x", "class_id")) -> DataFrame:
    """Views un-flipped (columns flip, direction, h, w) and averaged."""
    x = F.when(F.col("flip") & (F.col("direction") == "horizontal"), F.col("w") - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(F.col("flip") & (F.col("direction") == "vertical"), F.col("h") - 1 - F.col("y")).otherwise(F.col("y"))
    return views.withColumn("x", x).withColumn("y", y).groupBy(*keys).agg(F.avg("score").alias("score"))


def window_scores(patches: DataFrame, classes: DataFrame, images: DataFrame, crop: int, stride: int, patch: int, k: int = 400, gamma: float = 3.0, sigma: float = 0.01, power: float = 1.0, alpha: float = 0.95, iterations: int = 10) -> DataFrame:
    """Scores of each pixel and class (image_id, y, x, class_id, score) from features of windows' patches.

    `patches` has image_id, window_id, py, px and feat; windows are those of `windows(images, crop,
    stride)` of images at least as large, and have crop / patch patches a side. Zero-shot scores of
    all patches; one graph an image over the patches of all its windows, by likeness and distance,
    normalised; propagation; each window's scores resized to its pixels and averaged where windows
    overlap.
    """
    from rasterlake.operators.raster import resize_bilinear

    side = crop // patch
    square = side * side
    node = (F.col("window_id") * square + F.col("py") * side + F.col("px")).cast("long")
    nodes = patches.select(F.col("image_id").alias("graph_id"), "window_id", "py", "px", node.alias("node"), normalise(F.col("feat")).alias("feat"))
    corners = windows(images, crop, stride).select("image_id", "window_id", "y1", "x1")
    centres = patch_centers(nodes.drop("feat").join(corners.withColumnRenamed("image_id", "graph_id"), ["graph_id", "window_id"]), patch, F.col("y1"), F.col("x1"))
    edges = normalize_graph(symmetrize(knn_affinity(knn_join(nodes, k), centres, gamma, sigma, power)))
    start = zero_shot_scores(nodes, classes, ["graph_id", "node"]).withColumnRenamed("score", "y")
    found = propagate(edges, start, alpha, iterations)
    window = F.struct(F.col("graph_id").alias("g"), F.floor(F.col("node") / square).alias("window_id"))
    maps = found.select(window.alias("image_id"), F.floor(F.col("node") % square / side).alias("y"), (F.col("node") % side).alias("x"), "class_id", F.col("x").alias("score"))
    sizes = maps.select("image_id").distinct().withColumn("h", F.lit(side).cast("long")).withColumn("w", F.lit(side).cast("long"))
    fine = resize_bilinear(maps, sizes, F.lit(crop), F.lit(crop), ["score"], ("class_id",))
    fine = fine.select(F.col("image_id.g").alias("image_id"), F.col("image_id.window_id").alias("window_id"), F.col("y").alias("wy"), F.col("x").alias("wx"), "class_id", "score")
    placed = fine.join(corners, ["image_id", "window_id"]).select("image_id", (F.col("y1") + F.col("wy")).alias("y"), (F.col("x1") + F.col("wx")).alias("x"), "class_id", "score")
    return stage(overlap_merge(placed).drop("n_windows"), "merged")


def labels_at_original_size(scores: DataFrame, images: DataFrame, n_background: int = 1, digits: int = 6) -> DataFrame:
    """A label for each pixel of the original images (h0, w0 in `images`) from scores at size h, w: `image_id, y, x, label`.

    The expanded background columns are reduced, scores resized, and the class of the best score to
    `digits` digits taken, the lowest of equals.
    """
    from rasterlake.operators.metrics import argmax_label
    from rasterlake.operators.raster import resize_bilinear

    true = synonym_max(scores, ["image_id", "y", "x"], n_background)
    full = resize_bilinear(true, images, F.col("h0"), F.col("w0"), ["score"], ("class_id",))
    return argmax_label(full.withColumn("score", F.round("score", digits)), ["image_id", "y", "x"])


def segment(patches: DataFrame, classes: DataFrame, pixels: DataFrame, images: DataFrame, crop: int, stride: int, patch: int, n_background: int = 1, refine: bool = True, neigh: int = 6, tau: float = 0.01, alpha: float = 0.95, iterations: int = 10, **graph) -> DataFrame:
    """The whole chain: `window_scores`, with `refine` `refine_pixels` over the images as the model saw them (`pixels`), `labels_at_original_size`.

    Every step is a Spark join or sum, also for one large image.
    """
    scores = window_scores(patches, classes, images, crop, stride, patch, alpha=alpha, iterations=iterations, **graph)
    if refine:
        scores = refine_pixels(scores, pixels, neigh, tau, alpha, iterations)
    return labels_at_original_size(scores, images, n_background)
