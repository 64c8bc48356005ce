"""Toxicity, importance resampling and hard negatives against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rasterlake.llm import hard_negatives, queries, resampling, toxicity
from rasterlake.llm.hard_negatives import hilbert_key
from rasterlake.llm.tokens import Interned, equal_slices, joined, lower_words, xxh64
from rasterlake.llm.words import text_buffer

DATA = "/root/testdata"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def awkward_rows():
    r = random.Random(3)
    words = ["alpha", "Beta", "é1", "x", "gamma-delta", "Z" * 40, "ünï", "you"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), "en", "s", 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s", 1), (62, " \n.", "en", "s", 1), (63, "alpha " * 5000 + "w" * 70_000, "en", "s", 1), (None, "alpha beta " * 15, "en", "s", 1), (5, "gamma " * 25, "en", "s", 1)]
    return rows + rows[:2]  # repeated rows


# Tokens.


def test_words_and_hashes_of_slices():
    texts = ["One two", "", "tail", "É1-x.Y", "a" * 100 + " b", "end"]
    raw, s, e, offsets = lower_words(*text_buffer(pa.array(texts)))
    got = [[raw[a:b].tobytes().decode() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [plain_words(t) for t in texts]
    data, s, e = joined(raw, s, e)
    assert data.tobytes().decode() == "".join(w + " " for t in texts for w in plain_words(t))
    items = [bytes((i * 7 + n) % 251 for i in range(n)) for n in range(100)]
    ends = np.cumsum([len(x) for x in items])
    raw, s = np.frombuffer(b"".join(items), np.uint8), ends - np.array([len(x) for x in items])
    assert xxh64(raw, s, ends).tolist() == [xxhash.xxh64_intdigest(x) for x in items]


def test_interning_verifies_bytes_where_keys_meet():
    r = random.Random(1)
    items = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 1, 2, 8, 9, 70]))) for _ in range(300)] + [b"x" * 64 + c for c in (b"1", b"2", b"1")]
    ends = np.cumsum([len(x) for x in items])
    raw, s = np.frombuffer(b"".join(items), np.uint8), ends - np.array([len(x) for x in items])
    for keys in (None, np.zeros(len(items), np.uint64), np.arange(len(items), dtype=np.uint64) * 0 + np.uint64(2**64 - 1)):
        t = Interned(raw, s, ends, 1000, keys)
        assert [items[t.owner[i]] for i in t.slot] == items
        assert len(t.used) == len(set(items))
        assert {items[t.owner[i]]: int(t.count[i]) for i in t.used} == Counter(items)
        assert [int(b) for b in t.bucket[t.slot]] == [zlib.crc32(x) % 1000 for x in items]
    a, b = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    assert equal_slices(raw, s[a], ends[a], s[b], ends[b]).tolist() == [items[i] == items[j] for i, j in zip(a, b, strict=True)]


# Importance resampling.


def plain_resample(docs, target, lo=1, hi=1, buckets=10_000):
    def grams(text):
        w = plain_words(text)
        return [" ".join(w[i : i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]

    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(place(g) for d in docs for g in grams(d[1])), Counter(place(g) for d in target for g in grams(d[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + float(buckets)) / ((s[b] + 1.0) * (sum(t.values()) + float(buckets)))))
    out = []
    for d in docs:
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(g)) for g in grams(d[1]))
        out.append([d[0], len(grams(d[1])), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(d[1]))])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(able[: 10 * len(able) // 100]):
        x[4] = i + 1
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize(("lo", "hi"), [(1, 1), (1, 3)])
def test_resampling_of_awkward_rows(spark, monkeypatch, lo, hi):
    monkeypatch.setattr(resampling, "OCCURRENCES", 1000)
    rows, target = awkward_rows(), [(1, "alpha é1 é1"), (2, None), (3, "Beta x x")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as weight", "2 as score", "3 as rank", "'b' as id").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string"), lo=lo, hi=hi).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == plain_resample(rows, target, lo, hi)


def test_resampling_of_ties_and_empty_tables(spark):
    text = "alpha " * 20
    docs = spark.createDataFrame([(i % 4, text, "en", "s", 1) for i in range(40)], DOC)
    bench = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(docs, bench).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    best = max(r["score"] for r in got)
    assert {r["score"] for r in got if r["rank"]} == {best}
    assert resampling.resample(docs.limit(0), bench).count() == 0
    kept = resampling.drawn(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 10


def test_resampling_matches_its_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    found = c.execute(queries.OP12_SQL)
    names = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in queries.op12_resampling(spark, f"{DATA}/sf0.001").collect())


# Hard negatives.


def test_hilbert_key_walks_to_neighbours():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain_mine(rows, every=100, positives=5, negatives=10, low=30, high=90):
    good = [r for r in dict.fromkeys((i, l, None if v is None else tuple(v)) for i, l, v in rows) if None not in r and all(x is not None and math.isfinite(x) for x in r[2])]
    q = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in good]
    out = Counter()
    for a, la, va in q:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in q if i != a]  # noqa: B905
        for ps, p, _ in sorted(s for s in scored if s[2] == la)[:positives]:
            ok = sorted((ns, n) for ns, n, ln in scored if ln != la and low * -ps <= 100 * -ns <= high * -ps)
            for rank, (ns, n) in enumerate(ok[:negatives]):
                out[(a, p, rank + 1, n, -ps, -ns)] += 1
    return out


def vector_rows(n, dims, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=dims)
    rows = []
    for i in range(n):
        v = r.normal(size=dims) * 0.3 + centre * (0.5 if i % 3 else 0.2)
        rows.append((i, int(0 if i % 3 == 0 else r.integers(5)), [float(np.float32(x)) for x in v]))
    rows[7] = (7, None, rows[7][2])
    rows[8] = (8, 1, None)
    rows[9] = (9, 1, [None, *rows[9][2][1:]])
    rows[10] = (10, 1, [float("nan"), *rows[10][2][1:]])
    rows[11] = (11, 1, [float("inf"), *rows[11][2][1:]])
    rows[12] = (12, 1, rows[12][2][:2])
    rows[13] = (13, 1, [])
    rows += [rows[20], rows[30], (20, 3, rows[21][2])] + [(n + i, i % 2, rows[40][2]) for i in range(30)] + [(None, 1, rows[1][2])]
    return rows


@pytest.mark.parametrize(("block", "every"), [(2048, 10), (16, 7)])
def test_hard_negatives_of_awkward_rows(spark, monkeypatch, block, every):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 4 * block)
    monkeypatch.setattr(hard_negatives, "PACK_PARTS", 3)
    monkeypatch.setattr(hard_negatives, "CHUNK_ANCHORS", 8)
    rows = vector_rows(200, 6, 1)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as id", "2 as q", "3 as part", "4 as chunk").repartition(4)
    got = hard_negatives.mine(df, every=every)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = got.collect()
    assert Counter(tuple(r[c] for c in names) for r in found) == plain_mine(rows, every)
    assert all(r["blocks_read"] >= 1 for r in found)


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """Two far groups of vectors: the blocks of the one that points away are not read."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 100)
    r = np.random.default_rng(2)
    rows = [(i, i % 2, (r.normal(size=4) * 0.05 + (1 if i < 100 else -1)).tolist()) for i in range(400)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), low=50, high=100)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = got.where("anchor_id = 0").collect()
    assert Counter(tuple(x[c] for c in names) for x in found) == Counter({k: v for k, v in plain_mine(rows, low=50, high=100).items() if k[0] == 0})
    assert all(x["blocks_read"] < 16 for x in found)


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(empty).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(alone).count() == 0
    huge = spark.createDataFrame([(i, i % 2, [2.0**21] * 3) for i in range(4)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="scores must be below"):
        hard_negatives.mine(huge, every=1).count()


# Toxicity.


def auc(y, s):
    order = np.argsort(s, kind="stable")
    _, where, n = np.unique(s[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(s))
    rank[order] = (np.cumsum(n) - (n - 1) / 2)[where]
    p = int(y.sum())
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    got = queries.op11_toxicity(spark, f"{DATA}/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    assert len(y) > 500 and auc(y, s) > 0.97
    assert (got["predicted"][y == 0].mean() < 0.01) and got["predicted"][y == 1].mean() > 0.85
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()


def test_toxicity_of_awkward_rows(spark):
    rows = awkward_rows() + [(100 + i, f"plain words number {i} " * 8 + ("you stupid idiot!! " if i % 3 == 0 else ""), "en", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as id", "2 as features", "3 as score", "4 as label").repartition(3)
    labels = spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (100, 1, None), (61, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels, trees=5).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == ((r["doc_id"] - 100) % 3 == 0) for r in got if (r["doc_id"] or 0) >= 100)
    for few, score in ((labels.limit(0), 0.5), (labels.where("toxic = 0"), 0.0)):
        assert {r["score"] for r in toxicity.classify(docs, few).collect()} == {score}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_learns_beginnings_of_words(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [(i, " ".join(word() for _ in range(60)) + (f" zorq{word()} " if i % 6 == 0 else " ") + word(), "xx", "s", 1) for i in range(500)]
    docs = spark.createDataFrame(texts, DOC)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(500)], "doc_id long, toxic int")
    keys, weights = toxicity.learn_lexicon(docs, labels)
    assert 2 <= len(keys) <= 10 and (np.diff(keys.astype(object)) > 0).all() and (weights > 2).all()
    got = toxicity.classify(docs, labels, trees=5).collect()
    assert all(r["predicted"] == (r["doc_id"] % 6 == 0) for r in got)


def test_features_of_hidden_words_and_of_long_texts(monkeypatch):
    lexicon = toxicity.Lexicon(toxicity.LEXICONS)
    assert all(lexicon.hides(w) for w in ("1d1ot", "st*pid", "stuuuupid", "m0r0n", "i.d.i.o.t", "$cum"))
    assert not any(lexicon.hides(w) for w in ("n1ce", "he11o", "go*d", "w0nderful", "b2b"))
    names = {n: i for i, n in enumerate(toxicity._COUNTS)}
    part = toxicity._part(lexicon, *text_buffer(pa.array(["YOU IDIOT!! you", None, "an i d i o t and 1d1ot stuuupid", "x y", "the moron\nand you too far away from it all"])))
    counts, by_entry, most, least = part
    assert counts[:, names["second"]].tolist() == [2, 0, 0, 0, 1] and counts[:, names["shouted hits"]].tolist() == [1, 0, 0, 0, 0]
    assert counts[:, names["spelt hits"]].tolist() == [0, 0, 1, 0, 0] and counts[:, names["hidden hits"]].tolist() == [0, 0, 2, 0, 0]
    assert counts[:, names["repeats"]].tolist() == [1, 0, 0, 0, 0] and least.tolist() == [1, 10**6, 10**6, 10**6, 2]
    assert by_entry.sum(axis=1).tolist() == [1, 0, 0, 0, 1] and most[:, 0].tolist() == [1, 0, 0, 0, 1]
    text = "some plain words here and there " * 200 + "you idiot"
    whole = toxicity.features(lexicon, pa.array([text]))
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 1000)
    assert np.allclose(whole, toxicity.features(lexicon, pa.array([text])))
    assert toxicity.features(lexicon, pa.array(["", None])).shape == (2, toxicity.N_FEATURES)
