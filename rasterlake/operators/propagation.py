"""Label propagation by conjugate gradients over blocks of nodes that keep a halo of their neighbours.

A graph's nodes fall into blocks. A block holds its own part of the matrix once and for all, in a
table bucketed by block, and its vectors, with those of the nodes beyond its border that it needs
(the halo). A step multiplies within blocks and moves only the values of border nodes and a few
sums a graph: neither the matrix nor the vectors are shuffled. Two kinds of blocks exist: sparse
rows of any graph, and tiles of a picture whose weights are made from colours when they are used.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.scalars import lab
from rasterlake.sources.scratch import new_path, stage

#: Nodes of a block of a graph; tile edge of a picture, in pixels.
BLOCK_NODES, TILE = 1024, 64
#: Values (of a node and class) that one task of a step has.
VALUES = 1 << 16
KEYS = ["graph_id", "block"]
_STATE = "graph_id long, block long, x binary, r binary, p binary, q binary, sums array<double>"
_MESSAGE = "graph_id long, block long, sender long, data binary"

Arrays = dict[str, np.ndarray]


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> Arrays:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


class _Bucketed:
    """A table in the shared folder, bucketed by graph and block, so that reading it by these keys needs no shuffle."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name, self.path = df.sparkSession, f"blocks_{uuid.uuid4().hex}", new_path(df.sparkSession, "blocks")
        df.write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", self.path).saveAsTable(self.name)

    def read(self, *columns: str) -> DataFrame:
        rows = self.spark.table(self.name)
        return rows.select(*[F.col(c).alias(c) for c in columns or rows.columns])  # columns of its own for each use

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _coefficients(state: DataFrame, n_classes: int, limits: DataFrame | None, tol: float) -> DataFrame:
    """`graph_id, class, rr, limit, a, b` of the next step, from the blocks' sums of r.r, p.q, r.q and q.q.

    The new r.r follows from these sums, so that a step needs one sum over a graph and not two; it
    is summed anew at the next step, so that rounding does not add up. A system that has converged,
    or is all zero, stops changing.
    """
    parts = state.select("graph_id", F.posexplode("sums").alias("at", "v"))
    which = lambda k: F.sum(F.when(F.floor(F.col("at") / n_classes) == k, F.col("v")))
    sums = parts.groupBy("graph_id", (F.col("at") % n_classes).alias("class")).agg(which(0).alias("rr"), which(1).alias("pq"), which(2).alias("rq"), which(3).alias("qq"))
    sums = sums.withColumn("limit", F.col("rr") * tol * tol) if limits is None else sums.join(limits, ["graph_id", "class"])
    a = F.when(F.col("rr") <= F.col("limit"), 0.0).otherwise(F.coalesce(F.try_divide("rr", "pq"), F.lit(0.0)))
    after = F.col("rr") - 2 * F.col("a") * F.col("rq") + F.col("a") * F.col("a") * F.col("qq")
    b = F.when(F.col("a") == 0, 0.0).otherwise(F.greatest(F.coalesce(F.try_divide(after, F.col("rr")), F.lit(0.0)), F.lit(0.0)))
    return sums.withColumn("a", a).withColumn("b", b)


def _moved(x: np.ndarray, r: np.ndarray, p: np.ndarray, q: np.ndarray, own: np.ndarray, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = coef[0][:, None], coef[1][:, None]
    x = x + a * p[:, own]
    r = r - a * q
    return x, r, r + b * p


def _solve(fixed: _Bucketed, state: _Bucketed, n_classes: int, multiply: Callable[[Arrays, np.ndarray], np.ndarray], borders: Callable[[int, Arrays], Iterator[tuple[int, np.ndarray]]], places: Callable[[int, int, Arrays], np.ndarray], buckets: int, iterations: int, tol: float) -> tuple[_Bucketed, DataFrame]:
    """The last state, and the coefficients that x still has to be moved by.

    `multiply` gives A p at a block's own nodes, `borders` the neighbours that a block sends values
    to and which of its own nodes, and `places` where the values of a sender belong.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, data, q in zip(*[batch.column(i) for i in range(4)], strict=True):
                held = _unpack(data.as_py())
                values = np.frombuffer(q.as_py()).reshape(n_classes, -1)
                out = [(to, np.where(which >= 0, values[:, which], 0.0).tobytes()) for to, which in borders(block.as_py(), held)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(out), pa.int64()), pa.array([t for t, _ in out], pa.int64()), pa.array([block.as_py()] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], names=["graph_id", "block", "sender", "data"])

    def step(key: tuple, rows: pa.Table, messages: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("x", "r", "p", "q", "sums")}
        if rows.num_rows:
            held = _unpack(rows["fixed"][0].as_py())
            own, n_all = held["own"], int(held["n_all"])
            x, q = (np.frombuffer(rows[c][0].as_py()).reshape(n_classes, -1) for c in ("x", "q"))
            r, p = (np.frombuffer(rows[c][0].as_py()).reshape(n_classes, n_all) for c in ("r", "p"))
            whole = np.zeros((n_classes, n_all))
            whole[:, own] = q
            coef = None
            for sender, data in zip(messages["sender"].to_pylist(), messages["data"].to_pylist(), strict=True):
                if sender is None:
                    coef = np.frombuffer(data).reshape(2, n_classes)
                else:
                    whole[:, places(key[1].as_py(), sender, held)] = np.frombuffer(data).reshape(n_classes, -1)
            x, r, p = _moved(x, r, p, whole, own, coef)
            q = multiply(held, p)
            ro, po = r[:, own], p[:, own]
            sums = np.concatenate([(u * v).sum(axis=1) for u, v in ((ro, ro), (po, q), (ro, q), (q, q))])
            for c, v in zip(("x", "r", "p", "q"), (x, r, p, q), strict=True):
                out[c].append(np.ascontiguousarray(v).tobytes())
            out["sums"].append(sums.tolist())
        n = len(out["x"])
        kinds = {c: pa.binary() for c in "xrpq"} | {"sums": pa.list_(pa.float64())}
        return pa.table({"graph_id": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array([key[1].as_py()] * n, pa.int64()), **{c: pa.array(out[c], k) for c, k in kinds.items()}})

    def to_blocks(coefficients: DataFrame | None) -> DataFrame:
        """The coefficients as a message to every block of the graph."""
        blocks = fixed.read(*KEYS)
        if coefficients is None:  # r = y, p = r: the first state has q = -y
            return blocks.select(*KEYS, F.lit(None).cast("long").alias("sender"), F.lit(np.array([1.0] * n_classes + [0.0] * n_classes).tobytes()).alias("data"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = []
                for row in batch.column(2).to_pylist():
                    coef = np.zeros((2, n_classes))
                    for c in row:
                        coef[:, c["class"]] = c["a"], c["b"]
                    data.append(coef.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(len(data), pa.int64()), pa.array(data, pa.binary())], names=["graph_id", "block", "sender", "data"])

        listed = coefficients.groupBy("graph_id").agg(F.collect_list(F.struct("class", "a", "b")).alias("c"))  # a row a graph, of as many entries as classes
        return blocks.join(listed, "graph_id").select("graph_id", "block", "c").mapInArrow(packed, _MESSAGE)

    coefficients = limits = None
    for i in range(iterations):
        held = fixed.read().join(state.read(), KEYS)
        sent = held.select("graph_id", "block", "fixed", "q").mapInArrow(send, _MESSAGE)
        messages = sent.unionByName(to_blocks(coefficients))
        again = fixed.read().join(state.read(), KEYS)
        new = _Bucketed(again.groupBy(*KEYS).cogroup(messages.groupBy(*KEYS)).applyInArrow(step, _STATE), buckets)
        state.drop()
        state = new
        sums = state.read("graph_id", "sums")
        if i == 0:
            limits = stage(_coefficients(sums, n_classes, None, tol).select("graph_id", "class", "limit"), "limits")
        coefficients = _coefficients(sums, n_classes, limits, tol)
    return state, coefficients


def _finish(fixed: _Bucketed, state: _Bucketed, coefficients: DataFrame, classes: list, named: Callable[[int, Arrays], dict[str, np.ndarray]], kinds: str) -> DataFrame:
    """A row for each own node and class: the keys that `named` gives, class_id and value."""
    n_classes = len(classes)
    numbers = pa.array(classes, pa.int32())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, block, data, x, p, c = (batch.column(k)[i].as_py() for k in range(6))
                held = _unpack(data)
                own, n_all = held["own"], int(held["n_all"])
                a = np.zeros(n_classes)
                for one in c:
                    a[one["class"]] = one["a"]
                x = np.frombuffer(x).reshape(n_classes, -1) + a[:, None] * np.frombuffer(p).reshape(n_classes, n_all)[:, own]
                keys = named(block, held)
                keep = keys.pop("keep")
                m = len(keep)
                x = x[:, keep]
                columns = [pa.array(np.full(m * n_classes, g), pa.int64()), *[pa.array(np.tile(v, n_classes), pa.int64()) for v in keys.values()], numbers.take(pa.array(np.repeat(np.arange(n_classes), m))), pa.array(x.ravel())]
                if m:
                    yield pa.RecordBatch.from_arrays(columns, names=["graph_id", *keys, "class_id", "value"])

    listed = coefficients.groupBy("graph_id").agg(F.collect_list(F.struct("class", "a")).alias("c"))
    held = fixed.read().join(state.read("graph_id", "block", "x", "p"), KEYS).join(listed, "graph_id")
    return held.select("graph_id", "block", "fixed", "x", "p", "c").mapInArrow(rows_of, f"graph_id long, {kinds}, class_id int, value double")


def _measure(start: DataFrame) -> tuple[list[int], int]:
    """The classes, and into how many buckets the values of nodes and classes go: as many tasks each step has.

    By the number of values and not `spark.sql.shuffle.partitions`, as ten steps of nearly empty
    tasks take longer than the sums in them.
    """
    counts = {r["class_id"]: r["count"] for r in start.groupBy("class_id").count().collect()}  # as many as there are classes
    return sorted(counts), sum(counts.values()) // VALUES + 1


# Sparse rows of any graph.


def _sparse_multiply(alpha: float) -> Callable[[Arrays, np.ndarray], np.ndarray]:
    def multiply(held: Arrays, p: np.ndarray) -> np.ndarray:
        q = p[:, held["own"]].copy()
        src, w = held["src"], held["w"]
        if len(src):
            starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            for i in range(0, len(p), 16):  # some classes at a time
                q[i : i + 16, src[starts]] -= alpha * np.add.reduceat(w * p[i : i + 16, held["dst"]], starts, axis=1)
        return q

    return multiply


def _sparse_borders(block: int, held: Arrays) -> Iterator[tuple[int, np.ndarray]]:
    for to, a, b in zip(held["to"].tolist(), held["to_at"][:-1], held["to_at"][1:], strict=True):
        yield to, held["send"][a:b]


def _sparse_places(block: int, sender: int, held: Arrays) -> np.ndarray:
    i = int(np.searchsorted(held["peer"], sender))
    return held["halo"][held["peer_at"][i] : held["peer_at"][i + 1]]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array and the n+1 places where they begin."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.append(starts, len(values))


def propagate(edges: DataFrame, start: DataFrame, alpha: float = 0.95, iterations: int = 10, tol: float = 1e-6, block_nodes: int | None = None) -> DataFrame:
    """Solves (I - alpha W) x = y by conjugate gradients, `iterations` at most, by graph and class at once: `graph_id, node, class_id, x`.

    `edges` are normalised and symmetric; `start` has graph_id, node, class_id, y, and a node without
    a row for a class starts at 0 there. Nodes with numbers next to each other share a block. The
    edges of a block's nodes are packed once, in a bucketed table, with the list of nodes beyond the
    block that they lead to; in a step a block gets the values of those nodes, each once however
    many edges lead to it, and no edge moves. Edges to nodes without a start, or from them, count for nothing.
    """
    size = block_nodes or BLOCK_NODES
    classes, n = _measure(start)
    if not classes:
        return start.select("graph_id", "node", "class_id", F.col("y").alias("x"))
    n_classes = len(classes)
    if iterations < 1:
        return start.select("graph_id", "node", "class_id", F.lit(0.0).alias("x"))
    of = lambda c: F.floor(F.col(c) / size).cast("long")
    vectors = start.select(F.col("graph_id").cast("long").alias("graph_id"), of("node").alias("block"), "node", "class_id", F.col("y").cast("double").alias("y"))
    rows = edges.select(F.col("graph_id").cast("long").alias("graph_id"), of("src").alias("block"), "src", "dst", "w")

    def pack(key: tuple, s: pa.Table, e: pa.Table) -> pa.Table:
        out = {"fixed": [], "y": []}
        if s.num_rows:
            own, at = np.unique(s["node"].to_numpy(), return_inverse=True)
            y = np.zeros((n_classes, len(own)))
            np.add.at(y, (np.searchsorted(classes, s["class_id"].to_numpy()), at), s["y"].to_numpy())
            src, dst, w = (e[c].to_numpy() for c in ("src", "dst", "w")) if e.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            ok = own[np.minimum(np.searchsorted(own, src), len(own) - 1)] == src
            src, dst, w = src[ok], dst[ok], w[ok]
            inside = own[np.minimum(np.searchsorted(own, dst), len(own) - 1)] == dst
            beyond = np.unique(dst[~inside & (dst // size != key[1].as_py())])
            known = inside | (dst // size != key[1].as_py())  # others of this block have no start
            src, dst, w, inside = src[known], dst[known], w[known], inside[known]
            place = np.where(inside, np.searchsorted(own, dst), len(own) + np.searchsorted(beyond, dst))
            order = np.lexsort((place, src))
            out["fixed"].append(_pack(ids=own, own=np.arange(len(own)), n_all=np.array(len(own) + len(beyond)), src=np.searchsorted(own, src)[order], dst=place[order], w=w[order], beyond=beyond))
            out["y"].append(y.tobytes())
        m = len(out["y"])
        return pa.table({"graph_id": pa.array([key[0].as_py()] * m, pa.int64()), "block": pa.array([key[1].as_py()] * m, pa.int64()), "fixed": pa.array(out["fixed"], pa.binary()), "y": pa.array(out["y"], pa.binary())})

    packed = _Bucketed(vectors.groupBy(*KEYS).cogroup(rows.groupBy(*KEYS)).applyInArrow(pack, "graph_id long, block long, fixed binary, y binary"), n)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                beyond = _unpack(data)["beyond"]
                peers, cuts = _runs(beyond // size)
                if len(peers):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(peers), pa.int64()), pa.array(peers, pa.int64()), pa.array([block] * len(peers), pa.int64()), pa.array([beyond[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["graph_id", "block", "sender", "data"])

    def linked(key: tuple, rows: pa.Table, needs: pa.Table) -> pa.Table:
        """Blocks that know whom they send to; the place of a node that is asked for and not there is -1, whose value is 0."""
        out = []
        if rows.num_rows:
            held = _unpack(rows["fixed"][0].as_py())
            ids = held["ids"]
            to, send, cut = [], [np.zeros(0, np.int64)], [0]
            for asks, data in sorted(zip(needs["sender"].to_pylist(), needs["data"].to_pylist(), strict=True)):
                nodes = np.frombuffer(data, np.int64)
                place = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
                to.append(asks)
                send.append(np.where(ids[place] == nodes, place, -1))
                cut.append(cut[-1] + len(nodes))
            peers, at = _runs(held["beyond"] // size)
            halo = len(ids) + np.arange(len(held["beyond"]))
            out.append(_pack(ids=ids, own=held["own"], n_all=held["n_all"], src=held["src"], dst=held["dst"], w=held["w"], to=np.array(to, np.int64), to_at=np.array(cut), send=np.concatenate(send), peer=peers, peer_at=at, halo=halo))
        m = len(out)
        return pa.table({"graph_id": pa.array([key[0].as_py()] * m, pa.int64()), "block": pa.array([key[1].as_py()] * m, pa.int64()), "fixed": pa.array(out, pa.binary())})

    needs = packed.read("graph_id", "block", "fixed").mapInArrow(wanted, _MESSAGE)
    fixed = _Bucketed(packed.read("graph_id", "block", "fixed").groupBy(*KEYS).cogroup(needs.groupBy(*KEYS)).applyInArrow(linked, "graph_id long, block long, fixed binary"), n)
    state = _Bucketed(fixed.read().join(packed.read("graph_id", "block", "y"), KEYS).mapInArrow(_begin(n_classes), _STATE), n)
    packed.drop()
    state, coefficients = _solve(fixed, state, n_classes, _sparse_multiply(alpha), _sparse_borders, _sparse_places, n, iterations, tol)
    return _finish(fixed, state, coefficients, classes, lambda block, held: {"node": held["ids"], "keep": np.arange(len(held["ids"]))}, "node long").withColumnRenamed("value", "x")


def _begin(n_classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first state: x, r and p are 0 and q is -y, which a first step of 1 turns into r = p = y, halo and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, data, y in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                n_all = int(_unpack(data)["n_all"])
                y = np.frombuffer(y).reshape(n_classes, -1)
                zero = np.zeros((n_classes, n_all)).tobytes()
                columns = [pa.array([g], pa.int64()), pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in (np.zeros_like(y).tobytes(), zero, zero, (-y).tobytes())], pa.array([[]], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["graph_id", "block", "x", "r", "p", "q", "sums"])

    return run


# Tiles of a picture.


def _region(ty: int, tx: int, sy: int, sx: int, tile: int, neigh: int) -> tuple[slice, slice]:
    """Rows and columns, over the whole picture, of tile (sy, sx) that lie in the halo of tile (ty, tx)."""
    rows = slice(max(sy * tile, ty * tile - neigh), min((sy + 1) * tile, (ty + 1) * tile + neigh))
    return rows, slice(max(sx * tile, tx * tile - neigh), min((sx + 1) * tile, (tx + 1) * tile + neigh))


def _flat(rows: slice, cols: slice, y0: int, x0: int, width: int) -> np.ndarray:
    return (np.arange(rows.start - y0, rows.stop - y0)[:, None] * width + np.arange(cols.start - x0, cols.stop - x0)[None, :]).ravel()


def _tile_borders(tile: int, neigh: int):
    def borders(block: int, held: Arrays) -> Iterator[tuple[int, np.ndarray]]:
        sy, sx = divmod(block, 1 << 31)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                ty, tx = sy + dy, sx + dx
                if (dy or dx) and ty >= 0 and tx >= 0:
                    yield ty * (1 << 31) + tx, _flat(*_region(ty, tx, sy, sx, tile, neigh), sy * tile, sx * tile, tile)

    return borders


def _tile_places(tile: int, neigh: int):
    def places(block: int, sender: int, held: Arrays) -> np.ndarray:
        (ty, tx), (sy, sx) = divmod(block, 1 << 31), divmod(sender, 1 << 31)
        return _flat(*_region(ty, tx, sy, sx, tile, neigh), ty * tile - neigh, tx * tile - neigh, tile + 2 * neigh)

    return places


def _weights(colours: np.ndarray, neigh: int, tau: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each offset the weights of the pixels of `colours` without its rim; 0 where either pixel is missing (NaN)."""
    side_y, side_x = colours.shape[0] - 2 * neigh, colours.shape[1] - 2 * neigh
    own = colours[neigh : neigh + side_y, neigh : neigh + side_x]
    for dy in range(-neigh, neigh + 1):
        for dx in range(-neigh, neigh + 1):
            if dy or dx:
                other = colours[neigh + dy : neigh + dy + side_y, neigh + dx : neigh + dx + side_x]
                w = np.exp(-np.sqrt(((own - other) ** 2).sum(axis=2)) / tau)
                yield dy, dx, np.where(np.isnan(w), 0.0, w)


def _tile_multiply(alpha: float, tile: int, neigh: int, tau: float):
    side = tile + 2 * neigh

    def multiply(held: Arrays, p: np.ndarray) -> np.ndarray:
        n = len(p)
        scaled = (p * held["root"]).reshape(n, side, side)
        total = np.zeros((n, tile, tile))
        for dy, dx, w in _weights(held["colours"], neigh, tau):
            total += w * scaled[:, neigh + dy : neigh + dy + tile, neigh + dx : neigh + dx + tile]
        own = held["own"]
        return p[:, own] - alpha * held["root"][own] * total.reshape(n, -1)

    return multiply


def refine_pixels(scores: DataFrame, pixels: DataFrame, neigh: int = 6, tau: float = 0.01, alpha: float = 0.95, iterations: int = 10, tol: float = 1e-6, tile: int | None = None) -> DataFrame:
    """Scores (image_id, y, x, class_id, score) propagated over the grid of pixels (image_id, y, x, r, g, b), alike in colour.

    The graph joins each pixel to all within `neigh` steps, by likeness of colour, and is never
    written: a tile keeps its colours with a rim, makes the weights of an offset when it needs them and
    adds up shifted views. In a step a tile gets the rims of its neighbours' vectors. A pixel
    without a score for a class starts at 0; scores of pixels that `pixels` lacks are left out.
    """
    size = tile or TILE
    if 2 * neigh > size:
        raise ValueError("a tile must be at least twice as wide as the neighbourhood")
    classes, n = _measure(scores)
    if not classes:
        return scores.select("image_id", "y", "x", "class_id", "score")
    if iterations < 1:
        return scores.select("image_id", "y", "x", "class_id", F.lit(0.0).alias("score"))
    n_classes, side = len(classes), size + 2 * neigh

    def in_tiles(df: DataFrame, rim: int) -> DataFrame:
        reach = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - rim) / size), F.lit(0)), F.floor((F.col(c) + rim) / size))
        rows = df.withColumn("__ty", F.explode(reach("y"))).withColumn("__tx", F.explode(reach("x")))
        return rows.withColumn("block", (F.col("__ty") * (1 << 31) + F.col("__tx")).cast("long")).drop("__ty", "__tx")

    key = [F.col("image_id").cast("long").alias("graph_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")]
    colours = in_tiles(pixels.select(*key, *[c.alias(k) for k, c in zip(("l", "a", "b"), lab(F.col("r"), F.col("g"), F.col("b")), strict=True)]), 2 * neigh)
    values = in_tiles(scores.select(*key, "class_id", F.col("score").cast("double").alias("score")), 0)

    def pack(key: tuple, c: pa.Table, s: pa.Table) -> pa.Table:
        out = {"fixed": [], "y": []}
        ty, tx = divmod(key[1].as_py(), 1 << 31)
        wide = side + 2 * neigh
        picture = np.full((wide, wide, 3), np.nan)
        if c.num_rows:
            at = c["y"].to_numpy() - ty * size + 2 * neigh, c["x"].to_numpy() - tx * size + 2 * neigh
            picture[at] = np.stack([c[k].to_numpy() for k in ("l", "a", "b")], axis=1)
        inner = picture[2 * neigh : 2 * neigh + size, 2 * neigh : 2 * neigh + size]
        if not np.isnan(inner[:, :, 0]).all():
            degree = np.zeros((side, side))
            for _, _, w in _weights(picture, neigh, tau):
                degree += w
            held = picture[neigh : neigh + side, neigh : neigh + side]
            there = ~np.isnan(held[:, :, 0])
            root = np.where(there, 1 / np.sqrt(np.where(degree > 0, degree, 1.0)), 0.0)
            own = (np.arange(neigh, neigh + size)[:, None] * side + np.arange(neigh, neigh + size)[None, :]).ravel()
            y = np.zeros((n_classes, size, size))
            if s.num_rows:
                np.add.at(y, (np.searchsorted(classes, s["class_id"].to_numpy()), s["y"].to_numpy() - ty * size, s["x"].to_numpy() - tx * size), s["score"].to_numpy())
            y[:, ~there[neigh : neigh + size, neigh : neigh + size]] = 0
            out["fixed"].append(_pack(own=own, n_all=np.array(side * side), colours=held, root=root.ravel(), there=there.ravel()[own]))
            out["y"].append(y.tobytes())
        m = len(out["y"])
        return pa.table({"graph_id": pa.array([key[0].as_py()] * m, pa.int64()), "block": pa.array([key[1].as_py()] * m, pa.int64()), "fixed": pa.array(out["fixed"], pa.binary()), "y": pa.array(out["y"], pa.binary())})

    packed = _Bucketed(colours.groupBy(*KEYS).cogroup(values.groupBy(*KEYS)).applyInArrow(pack, "graph_id long, block long, fixed binary, y binary"), n)
    fixed = _Bucketed(packed.read("graph_id", "block", "fixed"), n)
    state = _Bucketed(packed.read().mapInArrow(_begin(n_classes), _STATE), n)
    packed.drop()
    state, coefficients = _solve(fixed, state, n_classes, _tile_multiply(alpha, size, neigh, tau), _tile_borders(size, neigh), _tile_places(size, neigh), n, iterations, tol)

    def named(block: int, held: Arrays) -> dict[str, np.ndarray]:
        ty, tx = divmod(block, 1 << 31)
        keep = np.flatnonzero(held["there"])
        return {"y": ty * size + keep // size, "x": tx * size + keep % size, "keep": keep}

    out = _finish(fixed, state, coefficients, classes, named, "y long, x long")
    return out.select(F.col("graph_id").alias("image_id"), "y", "x", "class_id", F.col("value").alias("score"))
