"""The numbered operators against brute force, on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from rasterlake.llm import bpe, exact_dedup, html_text, license_scan, mixing, ngram_join, pii, quality_fm, quality_rules, queries, substring_dedup
from rasterlake.llm.fm_index import FMIndex
from rasterlake.llm.words import blocks, spaced, split_words, text_buffer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, and so might clash with.
CLASHES = ["id", "sid", "n", "text_key", "words", "host", "size", "digest", "c", "v", "token", "class", "target", "label", "__x"]


def prose(r, n):
    return " ".join(r.choice(["the", "of", "Ab", "xyz", "word", "éa", "lo", "mi", "re", "so", "fa", "qui", "per"]) + r.choice(["", "a", "b", "1", ".", ","]) for _ in range(n))


def rows():
    r = random.Random(5)
    out = [(i, prose(r, r.randint(40, 160)), "en", f"s{i % 3}", 1) for i in range(30)]
    base = out[0][1]
    out += [(40, base, "en", "s0", None), (41, base.replace(" ", "\t\n "), None, "s0", 3), (42, base + " tail", "en", None, 3), (43, " ".join(base.split()[1:]), "en", "s1", 2)]
    out += [(50, None, None, None, None), (51, "", "en", "s1", 0), (52, " \n\t ", "en", "s2", 1), (53, "one", "en", "s2", 3), (54, "One", "en", "s2", 3), (55, "two words", "en", "s2", 9)]
    passage = prose(random.Random(9), 70)
    out += [(60 + i, prose(r, 30) + " " + passage + " " + prose(r, 20), "en", "s1", 4) for i in range(4)]
    out += [(70, "x" * 3000 + " " + prose(r, 3000) + "\n" + "the of " * 400, "en", "s0", 5), (71, "Released under the MIT License.\nmit license MIT license\nLicensed under the Apache License, Version 2.0.", "en", "s0", 5)]
    out += [(72, "write an email to ab.c@d-e.org or +49 (30) 1234 5678, card 4111 1111 1111 1111, host 10.0.0.255, iban GB82 WEST 1234 5698 7654 32", "en", "s0", 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def awkward(docs):
    """Repeated rows and null ids too."""
    return docs.unionByName(docs.where("doc_id in (3, 50, 60)")).unionByName(docs.where("doc_id in (1, 61)").withColumn("doc_id", F.lit(None).cast("long")))


def duck():
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text", "lang", "source", "n_chars"]))
    return c


def same(df, sql):
    found = duck().execute(sql)
    names = [d[0] for d in found.description]
    show = lambda v: "-" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = sorted(tuple(show(v) for v in r) for r in found.fetchall())
    got = sorted(tuple(show(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert got == want


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_as_the_pattern(docs):
    import pyarrow as pa

    texts = [r[1] for r in rows()]
    array = pa.array(texts)
    for lower in (False, True):
        seen = {}
        for start, part in blocks(array, 2000):
            h, s, e, at = split_words(*text_buffer(part), lower=lower)
            for i in range(len(part)):
                w = words(texts[start + i])
                w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w] if lower else w
                assert at[i + 1] - at[i] == len(w)
                for x, y in zip(w, h[at[i] : at[i + 1]]):
                    assert seen.setdefault(x, y) == y
        assert len(set(seen.values())) == len(seen)


def test_words_of_long_texts_in_parts(monkeypatch):
    """Hashes and places do not depend on where a long text is cut for hashing."""
    r = random.Random(8)
    texts = pa.array([prose(r, 3000) + "\n \t" + "y" * 70_000 + " " + prose(r, 500), None, "z" * 9000, prose(r, 40)])
    whole = split_words(*text_buffer(texts), lower=True)
    monkeypatch.setattr("rasterlake.llm.words.BLOCK_BYTES", 997)
    parts = split_words(*text_buffer(texts), lower=True)
    assert all((a == b).all() for a, b in zip(whole, parts))
    raw, _ = text_buffer(texts)
    data, place = spaced(raw, whole[1], whole[2])
    assert [data[a : b - 1].tobytes() for a, b in zip(place[:-1], place[1:])] == [raw[a:b].tobytes() for a, b in zip(whole[1], whole[2])]


def test_bpe(spark, awkward, empty):
    ranks = bpe.read_ranks(queries.RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(awkward, queries.RANKS, public_tokenizers.PATTERN).collect()
    text = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        if r["doc_id"] is not None:
            ids = enc.encode_ordinary(text[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert len(got) == awkward.count()
    ids = bpe.encode(awkward, queries.RANKS, public_tokenizers.PATTERN)
    assert all(r["decoded"].decode() == text[r["doc_id"]] for r in bpe.decode(ids, queries.RANKS).collect() if r["doc_id"] is not None)
    assert bpe.round_trip(empty, queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_merging_in_bulk():
    """Many pre-tokens in one queue, in bulk and one position at a time, against tiktoken; also ranks that no training gives."""
    ranks = bpe.read_ranks(queries.RANKS)
    r = random.Random(2)
    pieces = ["ab" * 4000, "a" * 3000, " " * 777, "x", *("".join(r.choice("aabthené ß") for _ in range(r.randint(1, 900))) for _ in range(60)), *("".join(r.choice("ab=-") for _ in range(r.randint(1, 60))) for _ in range(2000))]
    odd = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 300, b"aab": 270, b"aa": 310, b"abab": 290, b"ba": 305}
    for table in (ranks, odd):
        whole = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        merger = bpe.Merger(table)
        some = [p.encode() for p in pieces if p.encode() not in table]
        want = [whole.encode_ordinary(p.decode()) for p in some]
        for in_bulk in (True, False):
            assert [np.frombuffer(x, "<u4").tolist() for x in merger.merge(some, in_bulk)] == want
            assert not merger.queue.top and not merger.queue.buckets
    assert merger.merge([]) == []


def test_bpe_of_long_texts_and_a_small_cache(monkeypatch):
    ranks = bpe.read_ranks(queries.RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "TEXT_BYTES", 4000)
    monkeypatch.setattr(bpe, "RUN", 7)
    r = random.Random(3)
    tokenizer = bpe.Tokenizer(ranks, public_tokenizers.PATTERN, cache=50)
    for text in ["", prose(r, 900), "é" * 3000 + " " + prose(r, 400), prose(r, 900)]:
        assert [x.tolist() for x in tokenizer.encode([text])] == [enc.encode_ordinary(text)]


def test_exact_dedup(spark, docs, awkward, empty):
    same(exact_dedup.exact_duplicates(docs), queries.OP2_SQL)
    got = exact_dedup.exact_duplicates(awkward)
    assert got.count() == awkward.count() and got.where("kept is null").count() == 0
    kept = exact_dedup.drop_duplicates_of(awkward)
    assert kept.columns == awkward.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(r[1]) for r in rows()})
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates_of(empty).count() == 0


def test_exact_dedup_of_awkward_rows(spark, awkward):
    """Repeated rows and null ids against brute force; nothing of the index stays."""
    tables = len(spark.catalog.listTables())
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(awkward).collect())
    same_text = defaultdict(list)
    all_ = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in awkward.collect()]
    for i, t in all_:
        same_text[t].append(i)
    want = []
    for i, t in all_:
        keep = min((x for x in same_text[t] if x is not None), default=None)
        want.append((str(i), keep, len(same_text[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert len(spark.catalog.listTables()) == tables
    names = awkward.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "text")
    assert exact_dedup.exact_duplicates(names).where("kept").count() == sum(w[3] for w in want)


def test_digest_index_keeps_between_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, "batches_of_digests", 4)
    first = index.deduplicate(docs.where("doc_id >= 40"))
    assert first.where("kept").count() == first.select("text_sha256").distinct().count()
    again = {r["doc_id"]: r for r in index.deduplicate(docs.where("doc_id < 40")).collect()}
    assert again[0]["keep_id"] == 40 and not again[0]["kept"] and again[1]["kept"]
    assert spark.table("batches_of_digests").count() == docs.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).distinct().count()
    groups_ = spark.createDataFrame([(b"x", 1)], "digest binary, first_id long")
    plan = groups_.join(index._known(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1  # the batch's; the index is read by its buckets
    index.forget()
    assert not spark.catalog.tableExists("batches_of_digests")


def groups(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, k, percent).collect()}
    assert got == groups({r[0]: r[1] for r in rows()}, k, percent)


def test_ngram_join_of_many_near_copies(spark, awkward, empty):
    r = random.Random(3)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(120)] = f"n{r.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, 3, 90, sketch_bits=10).collect()}
    assert got == groups(texts, 3, 90)
    assert ngram_join.near_duplicates(awkward, 3, 90).count() == awkward.count()
    assert ngram_join.near_duplicates(empty, 3, 90).count() == 0
    kept = ngram_join.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 42").count() == 0 and kept.where("doc_id = 5").count() == 1


@pytest.mark.parametrize("blocks", [1, 6])
def test_ngram_join_counts_every_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "_BLOCK_SETS", 40 if blocks > 1 else 10**6)
    monkeypatch.setattr(ngram_join, "_SPREAD", blocks)
    r = random.Random(7)
    changed = [r.sample(range(150), r.randint(1, 4)) for _ in range(150)]
    texts = {i: " ".join(f"v{i}" if j in at else f"w{j}" for j in range(150)) for i, at in enumerate(changed)}
    texts |= {200 + i: f"x{i} " + " ".join(f"z{j}" for j in range(60)) for i in range(3)}  # three sets, all linked
    texts |= {210: " ".join(f"y{j}" for j in range(60)), 211: " ".join(f"y{j}" for j in range(61)), 212: "alone " * 3, 213: None}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(0, texts[0]), (201, texts[201])], "doc_id long, text string").repartition(4)
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in texts.items() for w in [(t or "").split()]}
    different = {frozenset(s) for s in sets.values() if s}
    want = {i: sum(len(s & x) * 100 >= len(s | x) * 90 for x in different if x != s) if s else 0 for i, s in sets.items()}
    assert want[200] == want[201] == want[202] == 2 and want[210] == 1 and 50 < max(want.values()) < 149
    got = ngram_join.near_duplicates(df, 3, 90, sketch_bits=10).collect()
    assert len(got) == len(texts) + 2
    assert all(x["n_links"] == want[x["doc_id"]] for x in got)


def test_ngram_join_of_awkward_rows(spark, awkward):
    """Repeated rows and null ids against brute force: a null id is in a group, but names none that has another id."""
    rows_ = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    texts = dict(enumerate(t for _, t in rows_))
    ids = [i for i, _ in rows_]
    group = groups(texts, 3, 90)
    members = defaultdict(set)
    for i, (_, top) in group.items():
        if ids[i] is not None:
            members[top].add(ids[i])
    want = sorted((str(ids[i]), n, min(members[top]) if n else ids[i]) for i, (n, top) in group.items())
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(awkward, 3, 90).collect()) == want


def test_ngram_join_links_sets_of_null_ids_and_tells_short_names_apart(spark):
    r = random.Random(1)
    base = [f"w{j}" for j in range(80)]
    texts = [(None, " ".join(base)), (4, " ".join([*base, "end"])), (9, " ".join(f"q{j}" for j in range(40)))]
    texts += [(100 + i, prose(r, 30)) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x["doc_id"]: x for x in ngram_join.near_duplicates(df, 3, 90).collect()}
    assert got[None]["component_id"] == 4 and got[None]["n_links"] == got[4]["n_links"] == 1
    short = {x["doc_id"]: x for x in ngram_join.near_duplicates(df, 3, 90, name_bits=4).collect()}
    assert {i: (x["n_shingles"], x["component_id"], x["n_links"]) for i, x in short.items()} == {i: (x["n_shingles"], x["component_id"], x["n_links"]) for i, x in got.items()}
    two = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base, "x"])), (2, "another text of the same id , not near")], "doc_id long, text string")
    assert sorted(x["text"][:7] for x in ngram_join.keep_one_of_each(two).collect()) == ["another", "w0 w1 w"]


def test_ngram_join_of_a_list_in_many_components(spark, monkeypatch):
    """2,000 sets that share one n-gram, rare in none of them, of which a few are near each other."""
    monkeypatch.setattr(ngram_join, "_LIST_BLOCK", 100)
    texts = {i: f"same three words {' '.join(f'u{i // 2 if i < 40 else i}x{j}' for j in range(19))}" + (" more" if i < 40 and i % 2 else "") for i in range(2000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(df, 3, 90).collect()}
    assert got == {i: i - i % 2 if i < 40 else i for i in texts}
    placed = spark.createDataFrame([(7, i, i // 3, 20, 0, *[0] * ngram_join.SIGNATURE) for i in range(700)], "token long, sid long, c long, n int, pos int, " + ", ".join(f"s{i} long" for i in range(ngram_join.SIGNATURE)))
    pairs = [(x["a"], x["b"]) for x in ngram_join._list_pairs(placed, 90).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i in range(700) for j in range(i + 1, 700) if i // 3 != j // 3}


def test_license_scan(docs, awkward, empty):
    same(license_scan.scan(docs), queries.OP5_SQL)
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (got[71]["n_base"], got[71]["base_labels"], got[71]["first_word"]) == (4, "apache,mit", 3)
    assert license_scan.scan(awkward).count() == awkward.count() and license_scan.scan(empty).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_license_scan_of_repeated_and_null_ids(spark, order):
    """Each row has the labels of its own text, in whatever order rows come."""
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows_ = [(1, notice), (1, "software " + " ".join(f"v{i}" for i in range(30))), (None, notice), (None, None), (1, notice)][::order]
    got = license_scan.scan(spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r["doc_id"]), r["labels"], r["score"]) for r in got) == [("1", "", 0.0), ("1", "mit", 1.0), ("1", "mit", 1.0), ("None", "", 0.0), ("None", "mit", 1.0)]


def test_every_notice_has_its_label(spark):
    """Wrapped after each three words, between other words."""
    rows_ = [(j, "Some words before it.\n" + re.sub(r"(\S+ \S+ \S+) ", r"\1\n", notice) + "\nand some after it") for j, (_, notice) in enumerate(license_scan.TEMPLATES)]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert all(label in got[j] for j, (label, _) in enumerate(license_scan.TEMPLATES))


def test_license_scan_of_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    cc = "* Licensed under\n * CC BY-NC\n * 4.0."
    fill = "\n".join(["some other words of a page"] * 40)
    texts = [mit, bsd, cc, fill + "\n\n" + mit + "\n" + fill, "one " * 31 + bsd + "\n" + mit, "\n".join(mit.split()[:10]), fill, None]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("cc", 1.0), 3: ("mit", 1.0), 4: ("bsd,mit", 1.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("", 0.0)}


def plain_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = "".join(c for c in m[0] if c in "0123456789")
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(docs, awkward, empty):
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice(["a", ".", "@", "-", "+", "1", "23", "255", "0", " ", "é", "4111111111111111", "(", ")", "b.c", "%", "٣"]) for _ in range(r.randint(0, 14)))
        assert plain_spans(t) == pii.base_spans(t)
    text = {x[0]: x[1] or "" for x in rows()}
    for x in pii.find(docs).collect():
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text[x["doc_id"]]))
        assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(x["spans"].split(","))
    one = pii.find(docs).where("doc_id = 72").first()
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"], one["n_iban"]) == (1, 1, 1, 1, 1)
    assert one["scores"][0] > pii.PRIOR["email"]
    assert pii.find(awkward).count() == awkward.count() and pii.find(empty).count() == 0
    masked = pii.mask(awkward)
    assert masked.columns == awkward.columns and "[iban]" in masked.where("doc_id = 72").first()["text"]


def test_ibans_before_other_words():
    for iban in ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947"):
        for after in ("", ".", " On Monday", " Bank", " 12 items", " WESTGB2L", " WESTGB2LXXX 77", " A", "\nBIC", "é x"[1:]):
            for before in ("", "iban ", "ACCT 12 ", "é "):
                text = before + iban + after
                assert pii.method_spans(text) == [(len(before), 4, len(before) + len(iban))]
        assert not pii.method_spans(f"X{iban}") and not pii.method_spans(f"{iban}7")
        assert pii.method_spans(f"iban{iban}und") == [(4, 4, 4 + len(iban))] and pii.method_spans(f"号{iban}号") == [(1, 4, 1 + len(iban))]
    assert not pii.method_spans("GB83 WEST 1234 5698 7654 32 On")
    two = "GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00"
    assert [two[a:b] for a, _, b in pii.method_spans(two)] == [two[:27], two[28:]]


def test_html(spark):
    model = html_text.fit(spark.createDataFrame([], "html string, text string"))
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><header class='site-header'><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav></header>"
        "<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Title &amp; more</h1><p>First para\n graph<br>of text, with <b>bold</b> words.<p>Second &lt;one&gt; here.<ul><li>item</ul></article>"
        "<aside class='sidebar'><p>Related pages</p></aside><section id='comments'><p>I liked this page very much indeed.</p></section><form><p>Subscribe</p></form><footer>&copy; host</footer><!-- <p>gone</p> --></body></html>"
    )
    want = "Title & more\n\nFirst para graph of text, with bold words.\n\nSecond <one> here.\n\nitem"
    rows_ = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", page[: page.index("here.")]), (1, "u", page)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("text", F.lit("x"))
    got = html_text.extract(pages, model).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == [want] * 2
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert [r["text"] for r in got if r["page_id"] == 4] == [want[: want.index("here.")].strip()]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    for hard in ("<" * 20000, "<p " * 5000, '<a "' * 5000, "<div>" * 3000 + "x", "</p>" * 5000, "&" * 5000):
        html_text.main_text(hard, model)


LAYOUTS = {
    "article": "<body><nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>First of all there is a paragraph, which has a clause, some more words, and then an end of its own.</p><p>Then another one follows, which is about as long as the first, and says what it has to say in full.</p></article><footer>Imprint of the site</footer></body>",
    "classes": "<body><div class='topnav'><a href='/'>Home</a> <a href='/n'>News</a></div><div id='main'><h1>Head</h1><p>First of all there is a paragraph, which has a clause, some more words, and then an end of its own.</p><p>Then another one follows, which is about as long as the first, and says what it has to say in full.</p></div><div class='sidebar'><a href='/x'>Other</a></div></body>",
    "banner": "<body><div class='cookie-banner'><p>We use cookies. Accept them.</p></div><main><h1>Head</h1><p>First of all there is a paragraph, which has a clause, some more words, and then an end of its own.</p><p>Then another one follows, which is about as long as the first, and says what it has to say in full.</p></main><form class='newsletter'><p>Subscribe now.</p></form></body>",
    "comments": "<body><article><h1>Head</h1><p>First of all there is a paragraph, which has a clause, some more words, and then an end of its own.</p><p>Then another one follows, which is about as long as the first, and says what it has to say in full.</p></article><section id='comments'><div class='comment'><p>I do not agree with any of this.</p></div></section></body>",
    "advert": "<body><div class='content'><h1>Head</h1><p>First of all there is a paragraph, which has a clause, some more words, and then an end of its own.</p><div class='advert'><p>Buy this fine thing today.</p></div><p>Then another one follows, which is about as long as the first, and says what it has to say in full.</p></div><aside><p>A note at the side.</p></aside></body>",
}


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_html_layouts(layout):
    model = html_text.Model(html_text.seed_counts())
    assert html_text.main_text(f"<html>{LAYOUTS[layout]}</html>", model) == "Head\n\nFirst of all there is a paragraph, which has a clause, some more words, and then an end of its own.\n\nThen another one follows, which is about as long as the first, and says what it has to say in full."


def test_html_learns_names_that_no_seed_has(spark):
    """Pages of a site with names of its own: what the seeds alone keep, the counts of labelled pages drop."""
    r = random.Random(4)

    def page(i):
        body = [prose(r, r.randint(15, 40)) + "." for _ in range(4)]
        html = f"<html><body><div class='haupt'>{''.join(f'<p>{b}</p>' for b in body)}<div class='werbung'><p>{prose(r, 12)}.</p></div></div><div class='fuss'><p>{prose(r, 12)}.</p></div></body></html>"
        return html, "\n\n".join(body)

    pages = [page(i) for i in range(60)]
    learned = html_text.fit(spark.createDataFrame(pages[:40], "html string, text string").repartition(3))
    seeds = html_text.Model(html_text.seed_counts())
    assert all(html_text.main_text(h, learned) == t for h, t in pages[40:])
    assert not any(html_text.main_text(h, seeds) == t for h, t in pages[40:])


def test_html_marginals_are_those_of_the_whole_table():
    model = html_text.Model(html_text.seed_counts())
    nodes = html_text.tree("<body><nav><a href='/'>Home</a></nav><article><p>Some words of text here.</p></article></body>")
    found = html_text.node_features(nodes)
    total, content = 0.0, np.zeros(len(nodes))
    for y in itertools.product(range(3), repeat=len(nodes)):
        p = 1.0
        for i, n in enumerate(nodes):
            p *= model.own(n, found[i])[y[i]]
            if i:
                p *= model.edge[y[n.parent]][y[i]]
        total += p
        content += p * (np.array(y) == html_text.ALL)
    assert model.marginals(nodes) == pytest.approx(list(content / total), abs=1e-9)
    shown = [model.shows[f] for f in found[-1] if f in model.shows]
    odds = [math.prod(s[y] for s in shown) ** 0.5 for y in range(2)]
    assert model.own(nodes[-1], found[-1]) == pytest.approx([odds[0] / sum(odds), odds[1] / sum(odds), 0])


def test_host_rules(docs, awkward, empty):
    same(quality_rules.apply_rules(docs), queries.OP8_SQL)
    assert quality_rules.apply_rules(awkward).count() == awkward.count() and quality_rules.apply_rules(empty).count() == 0


def test_a_bad_host_takes_its_poor_documents_along(spark):
    """Of six hosts one fails far more often: its poor documents go, those of the others and all clean ones stay."""
    r = random.Random(6)
    clean = lambda: " ".join(f"word{r.randint(0, 10**6)}" for _ in range(60))
    poor = lambda: clean() + " #" * 40
    rows_ = [(h * 1000 + i, f"h{h}", i < (80 if h == 3 else 8)) for h in range(6) for i in range(100)]
    df = spark.createDataFrame([(i, h, poor() if bad else clean()) for i, h, bad in rows_], "doc_id long, source string, text string")
    got = {x["doc_id"]: x["kept"] for x in quality_rules.apply_rules(df).collect()}
    assert all(got[i] == (not (bad and h == "h3")) for i, h, bad in rows_)


def test_awkward_rows_as_plain_python(awkward):
    """Repeated rows and null ids of the operators that work row by row, each row compared."""
    texts = sorted((str(x["doc_id"]), x["text"] or "") for x in awkward.collect())
    spans = sorted((str(x["doc_id"]), x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) for x in pii.find(awkward).collect())
    assert [x[0] for x in spans] == [i for i, _ in texts]
    assert all(x[1:] == ((1, 1, 1, 1) if i == "72" else (0, 0, 0, 0)) for x, (i, _) in zip(spans, texts))
    scanned = sorted((str(x["doc_id"]), x["n_words"]) for x in license_scan.scan(awkward).collect())
    assert scanned == sorted((i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))) for i, t in texts)
    ruled = sorted((str(x["doc_id"]), x["n_words"], x["word_chars"]) for x in quality_rules.apply_rules(awkward).collect())
    assert ruled == sorted((i, len(words(t)), sum(map(len, words(t)))) for i, t in texts)
    mixed = sorted((str(x["doc_id"]), x["size"]) for x in mixing.mix(awkward).collect())
    assert mixed == sorted((i, len(words(t))) for i, t in texts)


def test_substring_dedup_of_awkward_rows(spark, awkward):
    """Against brute force: rows of one id are one document, rows without an id neither lose words nor take any."""
    all_ = [(x["doc_id"], words(x["text"] or "")) for x in awkward.collect()]
    first = {}
    for i, w in all_:
        if i is not None:
            for j in range(len(w) - 49):
                key = tuple(w[j : j + 50])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in all_:
        gone = set()
        if i is not None:
            for j in range(len(w) - 49):
                if first[tuple(w[j : j + 50])] < i:
                    gone |= set(range(j, j + 50))
        want.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.remove_repeats(awkward).collect())
    assert got == sorted(want)
    named = awkward.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("doc_id"), "text")
    assert sorted(x["n_removed"] for x in substring_dedup.remove_repeats(named).collect()) == sorted(w[2] for w in want)


def test_substring_dedup_tells_words_with_near_hashes_apart(spark):
    """Two words whose hashes agree in 32 bits: windows that differ in them alone are different."""
    tail = " ".join(f"q0_{i}" for i in range(49))
    hashes, _, _, _ = split_words(*text_buffer(pa.array(["w47314 w190805"])))
    assert hashes[0] & np.uint64(0xFFFFFFFF) == hashes[1] & np.uint64(0xFFFFFFFF)
    df = spark.createDataFrame([(1, f"w47314 {tail}"), (2, f"w190805 {tail}"), (3, f"w47314 {tail}")], "doc_id long, text string")
    assert {x["doc_id"]: x["n_removed"] for x in substring_dedup.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 50}


def test_substring_dedup(docs, awkward, empty):
    same(substring_dedup.remove_repeats(docs), queries.OP9_SQL)
    assert substring_dedup.remove_repeats(awkward).count() == awkward.count() and substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_splits_hot_anchors(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 1)
    same(substring_dedup.remove_repeats(docs), queries.OP9_SQL)


def test_fm_index():
    r = np.random.default_rng(1)
    for _ in range(120):
        length, sigma = int(r.integers(2, 9)), int(r.integers(1, 5))
        seqs = [r.integers(0, sigma, r.integers(1, 25)) * 7 for _ in range(int(r.integers(1, 12)))]
        values = r.integers(0, 50, len(seqs))
        index = FMIndex(np.concatenate(seqs), np.cumsum([len(s) for s in seqs]), values, length)
        best = defaultdict(lambda: np.iinfo(np.int64).max)
        for s, v in zip(seqs, values):
            for i in range(len(s) - length + 1):
                best[tuple(s[i : i + length])] = min(best[tuple(s[i : i + length])], v)
        asked = [*seqs, *(r.integers(0, sigma + 1, r.integers(1, 25)) * 7 for _ in range(4))]
        want = [best[tuple(s[i : i + length])] for s in asked for i in range(len(s) - length + 1)]
        assert index.earliest(np.concatenate(asked), np.cumsum([len(s) for s in asked])).tolist() == want


def test_mixing(docs, awkward, empty):
    same(mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "times", "weight"), queries.OP10_SQL)
    got = mixing.mix(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight, full, rest = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(), 1.5 * sum(sizes.values())
    while True:
        left = rest - sum(2 * sizes[s] for s in full)
        share = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    assert all(target[s] == pytest.approx(share[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in names)
    assert mixing.mix(awkward).count() == awkward.count() and mixing.mix(empty).count() == 0
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns and applied.count() == sum(r["times"] for r in got)


def test_mixing_of_rows_that_share_an_id(spark):
    texts = [(1, "s", "one two three"), (1, "t", "four five six"), (1, "t", "seven eight nine"), (2, "s", "a b"), (2, "s", "a b"), (None, None, "x y z"), (None, "t", None)]
    df = spark.createDataFrame(texts * 3 + [(10 + i, "st"[i % 2], f"word{i} " * (i + 1)) for i in range(40)], "doc_id long, source string, text string")
    mixed = mixing.mix(df)
    applied = mixing.apply_mix(df)
    want = sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in mixed.collect() for _ in range(r["times"]))
    assert sorted((str(r["doc_id"]), str(r["source"]), len((r["text"] or "").split())) for r in applied.collect()) == want
    per_row = mixed.groupBy("doc_id", "source", "text_hash").agg(F.countDistinct("times").alias("n")).where("n > 1")
    assert per_row.count() == 0


def test_mixing_classes_are_small_for_any_weight(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("123 456").alias("text"))
    mixed = mixing.mix(df)
    largest = mixed.groupBy(F.floor(F.log2("sample_key") * mixing.OCTAVE_CLASSES)).count().agg(F.max("count")).first()[0]
    assert largest < 40
    assert abs(mixed.agg(F.sum("taken")).first()[0] - 1.5 * 40_000) <= 1


def test_quality(spark, awkward, empty):
    r = random.Random(1)
    good = [(i, prose(r, 80) + ".", "en", "s", 5) for i in range(300)]
    bad = [(1000 + i, " | ".join(prose(r, 1) + "$$$" for _ in range(60)), "en", "s", 5) for i in range(100)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    labels = df.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    got = quality_fm.classify(df, labels).collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x["held_out"]]
    assert np.mean([(x["predicted"] == 1) == (x["doc_id"] < 1000) for x in held]) > 0.97
    marks = labels.unionByName(labels.limit(5)).withColumn("id", F.lit(1)).withColumn("y", F.lit(2))
    odd = quality_fm.classify(awkward, marks)
    assert odd.count() == awkward.count() and all(0 <= x["score"] <= 1 for x in odd.collect())
    assert quality_fm.classify(empty, labels).count() == 0
    none = quality_fm.classify(df, labels.where("doc_id < 0"))
    assert {x["score"] for x in none.collect()} and none.count() == 400
    kept = quality_fm.keep_good(awkward, labels)
    assert kept.columns == awkward.columns


def test_machine_is_the_sum_over_pairs():
    r = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, r.normal(size=20).astype(np.float32), r.normal(size=(20, 4)).astype(np.float32))
    index, x = np.array([1, 4, 7, 2, 9]), np.array([0.5, 1.0, 0.25, 2.0, 1.0], np.float32)
    rows_ = np.array([0, 0, 0, 1, 1])
    for row, z in enumerate(m.margin(rows_, index, x, 2)):
        at = np.flatnonzero(rows_ == row)
        want = 0.3 + sum(m.w[index[i]] * x[i] for i in at) + sum(m.v[index[i]] @ m.v[index[j]] * x[i] * x[j] for i in at for j in at if i < j)
        assert z == pytest.approx(want, rel=1e-4)


def test_pipeline_stages(spark, awkward):
    import corpus_pipeline as cp

    docs = awkward
    sf = "/root/testdata/sf0.001"
    for i, (name, stage) in enumerate(cp.STAGES):
        out = cp.stage(stage(spark, docs, sf), name.replace(" ", "-"))
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
    assert docs.columns == ["doc_id", "ids", "n_tokens"]


LONG = """
import sys
import numpy as np, pyarrow as pa
from rasterlake.llm import ngram_join, quality_fm, substring_dedup
from rasterlake.llm.words import spaced, split_words, text_buffer
r = np.random.default_rng(1)
words = np.array([f"w{i:05d}" for i in range(60_000)])
text = " ".join(words[r.integers(0, len(words), 9_300_000)].tolist())
del words
texts = pa.array([text], pa.large_string() if len(text) > 2**31 - 1 else pa.string())
size = len(text)
del text
memory = lambda key: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(key))
before = memory("VmRSS:")
open("/proc/self/clear_refs", "w").write("5")  # the peak starts anew
assert size > 64_000_000
if sys.argv[1] == "quality":
    rows, index, x = quality_fm.features(texts, np.array([np.nan]))
    assert len(rows) > 60_000 // 2
elif sys.argv[1] == "ngrams":
    grams, rows = ngram_join._sets(texts, 3)
    assert len(grams) > 9_000_000
else:
    raw, at = text_buffer(texts)
    hashes, s, e, offsets = split_words(raw, at)
    row, anchor, first, last = substring_dedup._anchors(hashes, offsets, 50)
    data, place = spaced(raw, s, e)
    assert len(place) == 9_300_001 and len(row) > 300_000
print(size // 10**6, before // 1024, memory("VmHWM:") // 1024)
"""


@pytest.mark.parametrize("what", ["quality", "ngrams", "passages"])
def test_memory_of_a_very_long_text(what):
    """A text of 65 MB takes less than 1 GB of a worker's memory in the steps that hold most for it."""
    done = subprocess.run([sys.executable, "-c", LONG, what], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    size, before, peak = map(int, done.stdout.split()[-3:])
    assert peak - before + size < 1024, (size, before, peak)


def thue_morse(n, a, b):
    """Two words of n bytes whose polynomial hashes modulo 2^64 are equal for any odd base."""
    flip = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if f else a for f in flip), "".join(a if f else b for f in flip)


def test_words_with_one_polynomial_hash_are_told_apart(spark):
    one, other = thue_morse(1024, "a", "b")
    tail = " ".join(f"q{i}" for i in range(49))
    few = spark.createDataFrame([(1, f"{one} x y"), (2, f"{other} x y"), (3, f"{one} X y")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(few, 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    long_ = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(long_).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_ngrams_whose_hashes_meet_are_told_apart_by_their_words():
    texts = pa.array(["a b c d", "a b x d", "a b", "a b c d a b c"])
    raw, cut = text_buffer(texts)
    hashes, s, e, offsets = split_words(raw, cut, lower=True)
    _, rows, size = ngram_join._hashed(hashes, offsets, 3)
    order = np.argsort(rows, kind="stable")
    rows, size = rows[order], size[order]
    n = np.bincount(rows)
    first = offsets[rows] + np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
    numbers = ngram_join._by_words(np.zeros(len(rows), np.uint64), first, size, ngram_join.word_numbers(raw, s, e))
    found = [tuple(raw[s[f] : e[f + m - 1]].tobytes() for f, m in [(f, m)])[0] for f, m in zip(first, size, strict=True)]
    assert len(set(numbers)) == len(set(found)) == len(set(zip(numbers, found, strict=True)))


def test_slices_of_one_hash_are_equal():
    raw = np.frombuffer(b"abcdefghi abcdefgh abcdefghi abcdefg\0 abcdefghijklmnopqrstuvwxyz abcdefghijklmnopqrstuvwxyY", np.uint8)
    s, e = words_bounds(raw)
    from rasterlake.llm.words import hash_slices
    hashes = hash_slices(raw, s, e)
    texts = [raw[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    assert len(set(hashes.tolist())) == len(set(texts))
    assert not set(hashes.tolist()) & set(hash_slices(raw, s, e, 5).tolist())


def words_bounds(raw):
    spaces = np.flatnonzero(np.concatenate([[32], raw, [32]]) == 32)
    return spaces[:-1], spaces[1:] - 1


def test_host_rules_of_long_texts_in_pieces(docs, awkward):
    """Every text as a long one, in pieces of a few characters."""
    plain = quality_rules.measure(docs).collect()
    assert sorted(map(tuple, quality_rules.measure(docs, long_text=7).collect()), key=str) == sorted(map(tuple, plain), key=str)
    same(quality_rules.apply_rules(docs, long_text=100), queries.OP8_SQL)
    odd = quality_rules.measure(awkward, long_text=11).collect()
    assert sorted(map(tuple, odd), key=str) == sorted(map(tuple, quality_rules.measure(awkward).collect()), key=str)


def test_license_scan_of_long_texts_in_pieces(spark, docs, awkward):
    """Every text as a long one, in pieces of a few characters."""
    for df in (docs, awkward):
        plain = license_scan.scan(df).collect()
        for size in (9, 60):
            assert sorted(map(str, license_scan.scan(df, long_text=size).collect())) == sorted(map(str, plain))
    rows_ = [(j, "Some words before it.\n" + re.sub(r"(\S+ \S+ \S+) ", r"\1\n", notice) + "\nand some after it") for j, (_, notice) in enumerate(license_scan.TEMPLATES)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    assert sorted(map(str, license_scan.scan(df, long_text=40).collect())) == sorted(map(str, license_scan.scan(df).collect()))


ONE, TWO = "First of all there is a paragraph, which has a clause, some more words, and then an end of its own.", "Then another one follows, which is about as long as the first, and says what it has to say in full."
APART = {
    "form": "<form><p>{x}</p><label>Name</label></form>", "footer": "<footer><p>{x}</p></footer>", "aside": "<aside><p>{x}</p></aside>", "advert": "<div class='advert'><p>{x}</p></div>", "nav": "<nav><p>{x}</p></nav>",
    "comments": "<section class='comments'><p>{x}</p></section>", "sidebar": "<div id='sidebar'><p>{x}</p></div>", "notice": "<div class='cookie-notice'><p>{x}</p></div>", "share": "<div class='share-tools'><p>{x}</p></div>",
}
FRAMES = ["<body><article><h1>Head</h1><p>{a}</p>{x}<p>{b}</p></article></body>", "<body><form id='page'><div class='content'><h1>Head</h1><p>{a}</p><p>{b}</p>{x}</div></form></body>", "<body class='has-sidebar ads'><main><h1>Head</h1>{x}<p>{a}</p><p>{b}</p></main></body>"]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_parts_that_are_no_article_go_with_the_fitted_model(spark, sf):
    table = lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    model = html_text.fit(html_text.labelled_pages(table("pages"), table("documents")))
    words = "Here are some words, quite a few of them, that do not belong to the article, and an end."
    for part, frame in itertools.product(APART.values(), FRAMES):
        assert html_text.main_text(f"<html>{frame.format(a=ONE, b=TWO, x=part.format(x=words))}</html>", model) == f"Head\n\n{ONE}\n\n{TWO}"
    for layout in LAYOUTS.values():
        assert html_text.main_text(f"<html>{layout}</html>", model) == f"Head\n\n{ONE}\n\n{TWO}"
