"""Counts in boxes of label maps by summed-area tables: four look-ups a box, whatever its size.

Pictures are dealt to tiles, each with a rim as wide as its boxes reach, and a task makes the tables
of one tile. A pixel moves once, and to its neighbours' rims.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tile edge in pixels.
TILE = 256
_MISSING = np.iinfo(np.int64).min


def in_tiles(df: DataFrame, tile: int, rim: Column) -> DataFrame:
    """Each pixel once for its own tile and for each tile within `rim` of it: `ty`, `tx`."""
    reach = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - rim) / tile), F.lit(0)), F.floor((F.col(c) + rim) / tile))
    return df.withColumn("ty", F.explode(reach("y"))).withColumn("tx", F.explode(reach("x")))


def summed(a: np.ndarray) -> np.ndarray:
    """The sums of all boxes that start at the upper left corner; a row and a column of 0 before them."""
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(a, axis=0, dtype=np.int64), axis=1, out=out[1:, 1:])
    return out


def boxes(table: np.ndarray, height: int, width: int) -> np.ndarray:
    """The sums of all boxes of one size, by their upper left corners."""
    a, b = table.shape[0] - height, table.shape[1] - width
    return table[height:, width:] - table[:a, width:] - table[height:, :b] + table[:a, :b]


def uniform(labels: np.ndarray, d: int) -> np.ndarray:
    """Of a picture without its rim of d pixels: whether all (2d+1)^2 pixels around each have its label."""
    side = 2 * d + 1
    odd = boxes(summed(labels == _MISSING), side, side)
    across = boxes(summed(labels[:, 1:] != labels[:, :-1]), side, side - 1)  # changes of label within a box
    down = boxes(summed(labels[1:] != labels[:-1]), side - 1, side)
    return (odd == 0) & (across == 0) & (down == 0)


def _grid(table: pa.Table, columns: list[str], tile: int, d: int) -> tuple[list[np.ndarray], int, int]:
    """Label maps of the rectangle that a tile's own pixels fill, with a rim of d pixels, and the rectangle's upper left corner.

    A small picture takes no more room than it has pixels, whatever the tile's edge; a tile that has pixels of its rim only is empty.
    """
    top, left = table["ty"][0].as_py() * tile, table["tx"][0].as_py() * tile
    y, x = table["y"].to_numpy() - top, table["x"].to_numpy() - left
    own = (y >= 0) & (y < tile) & (x >= 0) & (x < tile)
    if not own.any():
        return [np.zeros((2 * d, 2 * d), np.int64) for _ in columns], top, left
    (y0, y1), (x0, x1) = ((int(i[own].min()), int(i[own].max()) + 1) for i in (y, x))
    near = (y >= y0 - d) & (y < y1 + d) & (x >= x0 - d) & (x < x1 + d)
    at, out = (y[near] - y0 + d, x[near] - x0 + d), []
    for column in columns:
        labels = np.full((y1 - y0 + 2 * d, x1 - x0 + 2 * d), _MISSING)
        labels[at] = table[column].to_numpy()[near]
        out.append(labels)
    return out, top + y0, left + x0


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def boundary_pixels(mask: DataFrame, d: int | Column, key: str = "image_id", label: str = "label", tile: int | None = None) -> DataFrame:
    """`key, y, x, label` of the pixels within d steps of another label, of a missing pixel or of the frame; d of at least 1 may differ by picture."""
    size = tile or TILE
    rows = mask.select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(label).cast("long").alias("label"), (F.lit(d) if isinstance(d, int) else d).cast("int").alias("d"))
    kind, label_kind = _kind(rows, key), _kind(mask, label)

    def find(table: pa.Table) -> pa.Table:
        d = table["d"][0].as_py()
        (labels,), y0, x0 = _grid(table, ["label"], size, d)
        own = labels[d : len(labels) - d, d : labels.shape[1] - d]
        y, x = np.nonzero((own != _MISSING) & ~uniform(labels, d))
        n = len(y)
        return pa.table({key: table[key].take(pa.array(np.zeros(n, np.int64))), "y": pa.array(y + y0), "x": pa.array(x + x0), "label": pa.array(own[y, x], pa.int64())})

    found = in_tiles(rows, size, F.col("d")).groupBy(key, "ty", "tx").applyInArrow(find, f"{key} {kind}, y long, x long, label long")
    return found.select(key, "y", "x", F.col("label").cast(label_kind).alias(label))


def boundary_counts(pairs: DataFrame, d: Column, ignore: int, key: str = "image_id", tile: int | None = None) -> DataFrame:
    """`key, class_id, a_inter, a_union, a_pred, a_gt` of the boundaries of `gt` and `pred`, in one pass over tiles; d may differ by picture. Labels to ignore count as missing."""
    size = tile or TILE
    rows = pairs.select(key, *[F.col(c).cast("long").alias(c) for c in ("y", "x", "gt", "pred")], d.cast("int").alias("d"))
    kind = _kind(rows, key)

    def count(table: pa.Table) -> pa.Table:
        d = table["d"][0].as_py()
        sides = []
        for labels in _grid(table, ["gt", "pred"], size, d)[0]:
            labels[labels == ignore] = _MISSING
            own = labels[d : len(labels) - d, d : labels.shape[1] - d]
            sides.append(np.where(uniform(labels, d), _MISSING, own))
        g, p = sides
        classes, at = np.unique(np.concatenate([g.ravel(), p.ravel()]), return_inverse=True)
        at = at.reshape(2, -1)
        n_g, n_p = (np.bincount(at[i], minlength=len(classes)) for i in range(2))
        both = np.bincount(at[0][at[0] == at[1]], minlength=len(classes))
        keep = np.flatnonzero(classes != _MISSING)
        counts = {"a_inter": both, "a_union": n_g + n_p - both, "a_pred": n_p, "a_gt": n_g}
        return pa.table({key: table[key].take(pa.array(np.zeros(len(keep), np.int64))), "class_id": pa.array(classes[keep].astype(np.int32)), **{k: pa.array(v[keep].astype(np.int64)) for k, v in counts.items()}})

    columns = ("a_inter", "a_union", "a_pred", "a_gt")
    found = in_tiles(rows, size, F.col("d")).groupBy(key, "ty", "tx").applyInArrow(count, f"{key} {kind}, class_id int, {', '.join(f'{c} long' for c in columns)}")
    return found.groupBy(key, "class_id").agg(*[F.sum(c).alias(c) for c in columns])


def box_histograms(pixels: DataFrame, wanted: DataFrame, size: int, label: str = "gt", ignore: int = 255, key: str = "image_id", tile: int | None = None) -> DataFrame:
    """`key, attempt, label, n`: how often each label but `ignore` occurs in each square box of `wanted` (key, attempt, oy, ox).

    A tile counts its share of each box by four look-ups a label; a pixel is in no row for a box.
    """
    edge = tile or TILE
    rows = in_tiles(pixels.select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(label).cast("long").alias("label")).where(F.col("label") != ignore), edge, F.lit(0))
    over = lambda c: F.sequence(F.floor(F.col(c) / edge), F.floor((F.col(c) + size - 1) / edge))
    asked = wanted.select(F.col(key).alias(key), F.col("attempt").cast("int").alias("attempt"), F.col("oy").cast("long").alias("oy"), F.col("ox").cast("long").alias("ox"))
    asked = asked.withColumn("ty", F.explode(over("oy"))).withColumn("tx", F.explode(over("ox")))
    kind, label_kind = _kind(rows, key), _kind(pixels, label)

    def count(table: pa.Table, boxes_: pa.Table) -> pa.Table:
        out = {"attempt": [np.zeros(0, np.int32)], "label": [np.zeros(0, np.int64)], "n": [np.zeros(0, np.int64)]}
        if table.num_rows and boxes_.num_rows:
            (labels,), y0, x0 = _grid(table, ["label"], edge, 0)
            y, x = (np.clip(np.stack([b, b + size]) - o, 0, n) for b, o, n in ((boxes_["oy"].to_numpy(), y0, labels.shape[0]), (boxes_["ox"].to_numpy(), x0, labels.shape[1])))
            attempt = boxes_["attempt"].to_numpy()
            for c in np.unique(table["label"].to_numpy()):
                t = summed(labels == c)
                n = t[y[1], x[1]] - t[y[0], x[1]] - t[y[1], x[0]] + t[y[0], x[0]]
                some = np.flatnonzero(n)
                out["attempt"].append(attempt[some])
                out["label"].append(np.full(len(some), c))
                out["n"].append(n[some])
        found = {k: np.concatenate(v) for k, v in out.items()}
        ids = (table if table.num_rows else boxes_)[key].take(pa.array(np.zeros(len(found["n"]), np.int64)))
        return pa.table({key: ids, "attempt": pa.array(found["attempt"], pa.int32()), "label": pa.array(found["label"]), "n": pa.array(found["n"])})

    counted = rows.groupBy(key, "ty", "tx").cogroup(asked.groupBy(key, "ty", "tx")).applyInArrow(count, f"{key} {kind}, attempt int, label long, n long")
    return counted.groupBy(key, "attempt", F.col("label").cast(label_kind).alias(label)).agg(F.sum("n").alias("n"))
