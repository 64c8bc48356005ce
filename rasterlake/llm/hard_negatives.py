"""Hard-negative mining: integer inner products over Hilbert-ordered blocks, read where zone maps allow a window's scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.llm.scratch import drop, stage

#: Rows of a block, and of a partition of blocks at most, on average.
BLOCK_ROWS, PART_ROWS = 2048, 32_768
#: Anchors that are compared with a partition of blocks at a time, on average; partitions whose zone maps are looked at together.
CHUNK_ANCHORS, PACK_PARTS, MOST_PARTS = 2048, 16, 64
#: Dimensions and bits of each that make the Hilbert key, and rows of least hash that these are chosen by.
#: Rows are indexed all, and results do not depend on the key.
KEY_DIMS, KEY_BITS, SAMPLE = 15, 4, 4096
#: Scores of this size and more are an error; below it a product of doubles is exact.
MOST_SCORE = 1 << 50


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points with whole coordinates below 2**bits: Gray-coded, transposed axes with their bits dealt in turn."""
    x = x.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def _encode(rows: DataFrame, scale: float, kinds: str) -> DataFrame:
    """`id, label, dims, q`: whole components as 32-bit numbers; rows with a null or non-finite component go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            n = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
            ends = np.cumsum(n)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            keep = np.flatnonzero(bad[ends] == bad[ends - n])
            good = np.repeat(bad[ends] == bad[ends - n], n)
            if np.abs(x[good]).max(initial=0) >= 1 << 31:
                raise ArithmeticError("components must be below 2^31 once scaled")
            q = np.where(good, x, 0).astype("<i4")
            data = [q[b - k : b].tobytes() for b, k in zip(ends[keep], n[keep], strict=True)]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(n[keep].astype(np.int32)), pa.array(data, pa.binary())], names=["id", "label", "dims", "q"])

    return rows.mapInArrow(run, f"{kinds}, dims int, q binary")


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    values = column.to_pylist()
    if all(len(v) == 4 * dims for v in values):
        return np.frombuffer(b"".join(values), "<i4").reshape(len(values), dims).astype(float)
    return np.frombuffer(b"".join(v.ljust(4 * dims, b"\0") for v in values), "<i4").reshape(len(values), dims).astype(float)


def _blocks(rows: DataFrame, dims: int, n: int, kinds: str) -> tuple[DataFrame, int]:
    """Rows ordered by label and Hilbert key, a block a row: `part, block, ids, labels, q`, and its zone map `low, high` by dimension and `found` labels."""
    sample = rows.select("id", "q").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # at most SAMPLE rows
    some = _matrix(sample["q"], dims)
    use = np.argsort(-some.var(axis=0), kind="stable")[:KEY_DIMS] if dims else np.zeros(0, int)
    low, high = some[:, use].min(axis=0), some[:, use].max(axis=0)
    step = np.maximum(high - low, 1) / (1 << KEY_BITS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                x = _matrix(part.column(3), dims)[:, use]
                key = hilbert_key(np.clip(np.floor((x - low) / step), 0, (1 << KEY_BITS) - 1), KEY_BITS) if dims else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(key)], names=["id", "label", "q", "key"])

    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_ROWS)), -(-n // PART_ROWS))
    ordered = rows.mapInArrow(keyed, f"{kinds}, q binary, key long").repartitionByRange(parts, "label", "key", "id").sortWithinPartitions("label", "key", "id", "q")
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def one(table: pa.Table) -> pa.RecordBatch:
            nonlocal block
            x = _matrix(table["q"], dims).astype("<i4")
            list_of = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), list_of(table["id"].combine_chunks()), list_of(table["label"].combine_chunks()), pa.array([x.tobytes()], pa.binary())]
            zone = [pa.array([x.min(axis=0).tobytes()], pa.binary()), pa.array([x.max(axis=0).tobytes()], pa.binary()), list_of(table["label"].combine_chunks().unique())]
            block += 1
            return pa.RecordBatch.from_arrays(columns + zone, names=["part", "block", "ids", "labels", "q", "low", "high", "found"])

        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(["id", "label", "q"])
            for row in range(0, table.num_rows, BLOCK_ROWS):
                piece = table.slice(row, BLOCK_ROWS)
                keys = list(zip(piece["id"].to_pylist(), piece["label"].to_pylist(), piece["q"].to_pylist(), strict=True))
                new = [k != (keys[i - 1] if i else last) for i, k in enumerate(keys)]  # a repeated row counts once
                last = keys[-1]
                piece = piece.filter(pa.array(new))
                waiting.append(piece)
                size += piece.num_rows
                if size >= BLOCK_ROWS:
                    whole = pa.concat_tables(waiting).combine_chunks()
                    yield one(whole.slice(0, BLOCK_ROWS))
                    waiting, size = [whole.slice(BLOCK_ROWS)], size - BLOCK_ROWS
        if size:
            yield one(pa.concat_tables(waiting).combine_chunks())

    schema = f"part int, block int, ids array<{id_kind}>, labels array<{label_kind}>, q binary, low binary, high binary, found array<{label_kind}>"
    return stage(ordered.mapInArrow(packed, schema), "blocks"), parts


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best allowed scores of each row, the first column of equal ones first."""
    n = scores.shape[1]
    rank = np.where(allowed, scores.astype(np.int64) * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
    top = np.argpartition(rank, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), rank.shape)
    rows = np.repeat(np.arange(len(scores)), top.shape[1])
    cols = top.ravel()
    ok = allowed[rows, cols]
    return rows[ok], cols[ok]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) and len(b) and np.abs(a).sum(axis=1).max() * np.abs(b).max(initial=0) >= MOST_SCORE:
        scores = a.astype(object) @ b.T.astype(object)
        if max(abs(int(scores.max())), abs(int(scores.min()))) >= MOST_SCORE:
            raise ArithmeticError(f"scores must be below {MOST_SCORE}")
        return scores.astype(float)
    return a @ b.T


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By interval arithmetic, the least and greatest inner product of each vector with anything in each zone."""
    up, down = np.maximum(a, 0), np.maximum(-a, 0)
    return up @ low.T - down @ high.T, up @ high.T - down @ low.T


def _anchors(blocks: DataFrame, dims: int, k: int, every: int) -> DataFrame:
    """`a, part, id, label, q, least` of the rows that are anchors; `least` is the k-th best score of its label in its own block, so that no block whose bound is lower is read."""
    id_kind, label_kind = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, labels = batch.column(2)[r].values, batch.column(3)[r].values
                number = ids.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(number % every == 0)
                x = np.frombuffer(batch.column(4)[r].as_py(), "<i4").reshape(len(ids), dims).astype(float)
                label = labels.dictionary_encode().indices.to_numpy()
                for i in range(0, len(at), 256):
                    some = at[i : i + 256]
                    scores = _product(x[some], x)
                    allowed = (label[some][:, None] == label[None, :]) & (number[some][:, None] != number[None, :])
                    if k <= scores.shape[1]:
                        least = np.sort(np.where(allowed, scores, -np.inf), axis=1)[:, -k]
                    else:
                        least = np.full(len(some), -np.inf)
                    take = pa.array(some)
                    a = (batch.column(0)[r].as_py() << 32) | (batch.column(1)[r].as_py() * BLOCK_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(a + some), pa.array(np.full(len(some), batch.column(0)[r].as_py(), np.int32)), ids.take(take), labels.take(take), pa.array([x[j].astype("<i4").tobytes() for j in some], pa.binary()), pa.array(least)], names=["a", "part", "id", "label", "q", "least"])

    return blocks.select("part", "block", "ids", "labels", "q").mapInArrow(run, f"a long, part int, id {id_kind}, label {label_kind}, q binary, least double")


def _to_read(anchors: DataFrame, blocks: DataFrame, dims: int, parts: int, same: bool) -> DataFrame:
    """`chunk, part, block, who`: the anchors of a chunk that have to read a block.

    A block is read for positives where it has the anchor's label and its greatest score can reach
    the anchor's `least`; for negatives where it has another label and its scores can lie in one of
    the anchor's `windows`.
    """
    packs = -(-parts // PACK_PARTS)
    chunks = anchors.select("chunk").distinct()
    zones = blocks.select("part", "block", "low", "high", "found", F.floor(F.col("part") / PACK_PARTS).cast("int").alias("pack"))
    zones = zones.join(chunks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))), "pack")
    left = anchors.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))

    def choose(key: tuple, rows: pa.Table, zone: pa.Table) -> pa.Table:
        out = {"part": [], "block": [], "who": []}
        if rows.num_rows and zone.num_rows:
            x, a = _matrix(rows["q"], dims), rows["a"].to_numpy()
            names = {v: i for i, v in enumerate(rows["label"].unique().to_pylist())}
            label = np.array([names[v] for v in rows["label"].to_pylist()])
            holds, more = np.zeros((zone.num_rows, len(names)), bool), np.zeros(zone.num_rows, np.int64)
            for i, found in enumerate(zone["found"].to_pylist()):
                holds[i, [names[v] for v in found if v in names]] = True
                more[i] = len(found)
            lower, upper = _bounds(x, _matrix(zone["low"], dims), _matrix(zone["high"], dims))
            own = holds[:, label].T
            if same:
                need = own & (upper >= rows["least"].to_numpy()[:, None])
            else:
                need = np.zeros(own.shape, bool)
                for i, windows in enumerate(rows["windows"].to_pylist()):
                    for w in windows:
                        need[i] |= (upper[i] * 100 >= w["low"]) & (lower[i] * 100 <= w["high"])
                need &= (more[None, :] - own) > 0
            for j in np.flatnonzero(need.any(axis=0)):
                out["part"].append(zone["part"][int(j)].as_py())
                out["block"].append(zone["block"][int(j)].as_py())
                out["who"].append(a[need[:, j]].tobytes())
        n = len(out["part"])
        return pa.table({"chunk": pa.array([key[0].as_py()] * n, pa.int32()), "part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "who": pa.array(out["who"], pa.binary())})

    zones = zones.select(*[F.col(c).alias(c) for c in zones.columns])  # columns of its own
    return left.groupBy("chunk", "pack").cogroup(zones.groupBy("chunk", "pack")).applyInArrow(choose, "chunk int, part int, block int, who binary")


def _search(anchors: DataFrame, blocks: DataFrame, work: DataFrame, dims: int, k: int, same: bool, id_kind: str) -> DataFrame:
    """`a, window, score, found`: of each partition of blocks the k best scores in each window, from the blocks in `work`."""
    right = work.join(blocks.select("part", "block", "ids", "labels", F.col("q").alias("x")), ["part", "block"])
    left = anchors.join(work.select("chunk", "part").distinct().withColumnRenamed("part", "to"), "chunk").drop("part").withColumnRenamed("to", "part")

    def compare(rows: pa.Table, held: pa.Table) -> pa.Table:
        found = {"a": [], "window": [], "score": [], "found": []}
        best: dict[str, np.ndarray] = {}
        if rows.num_rows and held.num_rows:
            rows = rows.sort_by("a")
            a, ids, labels = rows["a"].to_numpy(), rows["id"].to_numpy(), rows["label"].to_pylist()
            every = _matrix(rows["q"], dims)
            windows = rows["windows"].to_pylist() if not same else None
            for r in range(held.num_rows):
                there = held["ids"][r].values
                order = np.argsort(there.to_numpy(zero_copy_only=False), kind="stable")
                there = there.take(pa.array(order))
                number = there.to_numpy(zero_copy_only=False)
                theirs = held["labels"][r].values.take(pa.array(order)).to_pylist()
                names = {v: i for i, v in enumerate(dict.fromkeys(theirs))}
                their = np.array([names[v] for v in theirs])
                x = np.frombuffer(held["x"][r].as_py(), "<i4").reshape(len(order), dims).astype(float)[order]
                who = np.searchsorted(a, np.frombuffer(held["who"][r].as_py(), np.int64))
                for i in range(0, len(who), 256):
                    w = who[i : i + 256]
                    scores = _product(every[w], x)
                    alike = np.array([names.get(labels[j], -1) for j in w])[:, None] == their[None, :]
                    other = number[None, :] != ids[w][:, None]
                    for t in range(1 if same else max(len(windows[j]) for j in w)):
                        if same:
                            allowed = alike & other
                        else:
                            low = np.array([windows[j][t]["low"] if t < len(windows[j]) else np.inf for j in w])
                            high = np.array([windows[j][t]["high"] if t < len(windows[j]) else -np.inf for j in w])
                            allowed = ~alike & other & (scores * 100 >= low[:, None]) & (scores * 100 <= high[:, None])
                        row, col = _best(scores, allowed, k)
                        found["a"].append(a[w[row]])
                        found["window"].append(np.full(len(row), t))
                        found["score"].append(scores[row, col].astype(np.int64))
                        found["found"].append(number[col])
            best = {c: np.concatenate(v) for c, v in found.items()}
            order = np.lexsort((best["found"], -best["score"], best["window"], best["a"]))
            best = {c: v[order] for c, v in best.items()}
            new = np.concatenate([[True], (best["a"][1:] != best["a"][:-1]) | (best["window"][1:] != best["window"][:-1])]) if len(order) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            best = {c: v[nth < k] for c, v in best.items()}
        get = lambda c: best.get(c, np.zeros(0, np.int64))
        return pa.table({"a": pa.array(get("a"), pa.int64()), "window": pa.array(get("window").astype(np.int32)), "score": pa.array(get("score"), pa.int64()), "found": pa.array(get("found"))})

    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own
    near = left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInArrow(compare, f"a long, window int, score long, found {id_kind}")
    rank = F.row_number().over(W.Window.partitionBy("a", "window").orderBy(F.desc("score"), "found"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Hard negatives of each anchor and positive: `anchor_id, positive_id, rank, negative_id, positive_score, negative_score`, and `blocks_read` of the anchor's windows.

    A component counts as floor(scale * x); a score is the whole inner product with the anchor;
    higher ones come first, ties by smaller id. Anchors are rows whose (whole) id is divisible by
    `every`. An anchor's positives are its first `positives` other rows of its label. For each, the
    first `negatives` rows of another label come back whose score is between `low` and `high` percent
    of the positive's, bounds included; a positive without any gives no row.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors
    shorter than the longest end in zeros. A repeated row counts once; rows that share an id with the
    anchor are neither its positives nor its negatives. An empty table gives no rows. Scores of 2^50
    and more are an error. Other columns play no part.

    1. All rows are ordered by label and by their place on a Hilbert curve through the dimensions of
       most variance, in sampled ranges, and written in Parquet, a row a block of `BLOCK_ROWS` with
       the least and greatest value of each dimension (its zone map).
    2. Chunks of anchors meet the zone maps, pack by pack. Interval arithmetic bounds the scores in a
       block: for positives, blocks of the anchor's label are read that can reach what its own block
       already gives; for negatives, blocks that can have scores in one of its windows.
    3. A partition of blocks meets the chunks that read it; each keeps the best of a window, which are
       ranked at the end. No task holds more than a chunk and a partition of blocks.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where("id is not null and label is not null and v is not null")
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    kinds = f"id {id_kind}, label {label_kind}"
    rows = stage(_encode(rows, float(scale), kinds), "vectors")
    dims, n = rows.agg(F.coalesce(F.max("dims"), F.lit(0)), F.count(F.lit(1))).first()
    names = [F.col("id").alias("anchor_id"), F.col("positive_id"), F.col("rank"), F.col("negative_id"), F.col("positive_score"), F.col("negative_score"), F.col("blocks_read")]
    if not n:
        return rows.sparkSession.createDataFrame([], f"anchor_id {id_kind}, positive_id {id_kind}, rank int, negative_id {id_kind}, positive_score long, negative_score long, blocks_read long")
    blocks, parts = _blocks(rows, dims, n, kinds)
    drop(rows)
    anchors = stage(_anchors(blocks, dims, positives, every), "anchors")
    chunk = int(np.clip(CHUNK_ANCHORS * parts // max(1, anchors.count()), 1, MOST_PARTS))
    anchors = anchors.withColumn("chunk", F.floor(F.col("part") / chunk).cast("int"))

    work = stage(_to_read(anchors, blocks, dims, parts, same=True), "work")
    near = stage(_search(anchors, blocks, work, dims, positives, True, id_kind), "positives")
    drop(work)
    window = F.struct((F.col("score") * low).cast("double").alias("low"), (F.col("score") * high).cast("double").alias("high"))
    windows = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", window.alias("w")))).alias("ws"))  # at most `positives` an anchor
    aimed = stage(anchors.drop("least").join(windows, "a").withColumn("windows", F.transform("ws", lambda w: w["w"])).drop("ws"), "windows")

    work = stage(_to_read(aimed, blocks, dims, parts, same=False), "work")
    far = _search(aimed, blocks, work, dims, negatives, False, id_kind)
    far = far.select("a", (F.col("window") + 1).alias("nth"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("a", F.col("rank").alias("nth"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    read = work.select("chunk", (F.octet_length("who") / 8).cast("long").alias("n"))
    read = read.groupBy("chunk").agg(F.sum("n").alias("reads")).join(aimed.groupBy("chunk").agg(F.count(F.lit(1)).alias("m")), "chunk").select("chunk", (F.col("reads") / F.col("m")).cast("long").alias("blocks_read"))
    return far.join(pairs, ["a", "nth"]).join(anchors.select("a", "id", "chunk"), "a").join(read, "chunk").select(*names)
