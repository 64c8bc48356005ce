"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from rasterlake.llm.pieces import is_long, pieces, with_next
from rasterlake.llm.scratch import stage

#: Phrases of the base rule.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as their licenses word them, several of a label where a license has several; a block
#: that holds `containment` of a notice's words has its label. Fixed values.
TEMPLATES = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what is not a letter, a digit or beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_line(text: Column) -> Column:
    """The words, lower-cased in ASCII, with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def _n_words(line: Column) -> Column:
    return F.when(F.length(line) <= 2, 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) - 1)


def phrase_places(line: Column, phrase: str) -> Column:
    """The word positions at which a phrase starts: the words before each piece that ends where a phrase starts.

    The line is cut at each occurrence, with a look-ahead for the closing space, so that
    occurrences that follow each other at once all count.
    """
    pieces = F.split(line, f"(?<= ){phrase}(?= )")
    spaces = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))
    length = len(phrase.split())
    # Each piece but the first starts with the space after a phrase: of `length` words.
    return F.aggregate(spaces, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at")), lambda acc, s: F.struct((acc["sum"] + s + length - 1).alias("sum"), F.concat(acc["at"], F.array(acc["sum"] + s - 1)).alias("at")))["at"]


def _name(i: int) -> str:
    """The name of a template: its label and number."""
    return f"{TEMPLATES[i][0]}#{i}"


def template_tokens(spark: SparkSession) -> DataFrame:
    """`name, token` of the templates: some hundreds of rows, whatever the corpus holds."""
    rows = spark.createDataFrame([(_name(i), notice) for i, (_, notice) in enumerate(TEMPLATES)], "name string, notice string")
    return rows.select("name", F.explode(F.array_distinct(F.split(F.trim(words_line(F.col("notice"))), " "))).alias("token"))


def _vocabulary() -> list[str]:
    return sorted({w for _, notice in TEMPLATES for w in _ascii_words(notice)})


def _tokens(line: Column) -> Column:
    return F.array_intersect(F.split(line, " "), F.array(*[F.lit(t) for t in _vocabulary()]))


def template_matches(rows: DataFrame, containment: float = 0.8, long_text: int | None = None) -> DataFrame:
    """`id, key, label, score` of the blocks that hold at least `containment` of a template's distinct words.

    `rows` has `id`, `key` (which tells the texts of an id apart) and `text`. Blocks are lines, and for notices that are wrapped over lines,
    windows of twice a template's words over the whole text, each half over the next: any run of
    words as long as the notice is in one of them. Only texts that hold enough of a template's
    words at all have blocks. Tokens are ordered by the number of documents that hold them,
    counted over all documents. Blocks are inverted lists: each place of a template's word says which
    blocks it lies in, so that no array grows with the text, and texts of over `long_text` bytes
    (1 MB) are read in pieces. A block that reaches the threshold holds one of a template's
    first size - ceil(t size) + 1 tokens (prefix filter), has at least ceil(t size) distinct
    words (length filter), and has enough of the template's tokens from its first match on
    (positional filter). The token tables are of fixed size and are the broadcast side.
    """
    spark = rows.sparkSession
    templates = template_tokens(spark)
    words_of = {_name(i): _ascii_words(notice) for i, (_, notice) in enumerate(TEMPLATES)}
    tokens_of = {name: sorted(set(words)) for name, words in words_of.items()}
    needs = {name: -(-int(containment * 1000) * len(tokens) // 1000) for name, tokens in tokens_of.items()}
    enough = F.lit(False)
    for name, tokens in tokens_of.items():
        enough = enough | (F.size(F.array_intersect("tokens", F.array(*map(F.lit, tokens)))) >= needs[name])
    short = rows.where(~is_long(F.col("text"), long_text)).select("id", "key", "text", _tokens(words_line(F.col("text"))).alias("tokens"))
    found = stage(short.select("id", "key", "tokens", F.when(enough, F.col("text")).alias("text")), "license-tokens")  # whole texts of the few that may match
    texts = found.where(F.col("text").isNotNull()).select("id", "key", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("before"), "text")
    listed, tokens = texts, found.select("tokens")
    longer = stage(rows.where(is_long(F.col("text"), long_text)).dropDuplicates(["id", "key"]), "long-texts")
    if longer.limit(1).count():
        keys = ["id", "key"]
        parts = stage(pieces(longer, keys, SPLIT, long_text), "pieces")
        held = parts.select("id", "key", F.explode(_tokens(words_line(F.col("text")))).alias("token")).groupBy("id", "key").agg(F.collect_set("token").alias("tokens"))
        held = stage(held.withColumn("enough", enough), "long-tokens")  # a row a long text, of the vocabulary at most
        tokens = tokens.unionByName(held.select("tokens"))
        some = held.where("enough").select(F.col("id").alias("w_id"), F.col("key").alias("w_key"))
        chosen = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))
        words = with_next(parts.join(some, chosen, "left_semi").select("id", "key", "part", "text", F.split(F.trim(words_line(F.col("text"))), " ").alias("words")).withColumn("words", F.filter("words", lambda x: x != "")), keys, "words", 1)
        listed = texts.unionByName(words.select("id", "key", F.col("part").cast("long").alias("part"), F.col("before").cast("long").alias("before"), "text"))
        texts = texts.unionByName(pieces(longer.join(some, chosen, "left_semi"), keys, r"\n", long_text).select("id", "key", F.col("part").cast("long").alias("part"), F.lit(0).cast("long").alias("before"), "text"))
    df = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = stage(df, "license-df")  # at most one row a template token
    order = W.Window.partitionBy("name").orderBy("df", "token")
    size = F.count(F.lit(1)).over(W.Window.partitionBy("name"))
    ranked = templates.join(df, "token", "left").na.fill(0, ["df"]).withColumn("pos", F.row_number().over(order) - 1).withColumn("size", size)
    ranked = ranked.withColumn("need", F.ceil(F.lit(containment) * F.col("size") - 1e-9).cast("int"))
    lengths = F.create_map(*[F.lit(x) for name, words in words_of.items() for x in (name, len(words))])
    ranked = F.broadcast(stage(ranked.select("token", "name", "pos", "size", "need", F.element_at(lengths, F.col("name")).alias("n")), "license-order"))  # a row a template and token

    vocabulary = F.array(*[F.lit(t) for t in _vocabulary()])
    in_lines = texts.select("id", "key", "part", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    in_lines = in_lines.select("id", "key", "part", "line", F.array_intersect(F.split(words_line(F.col("words")), " "), vocabulary).alias("tokens")).where(F.size("tokens") >= min(needs.values()))
    in_lines = in_lines.select("id", "key", "part", "line", F.explode("tokens").alias("token")).join(ranked, "token")
    in_lines = in_lines.select("id", "key", "name", F.col("part").alias("a"), F.col("line").cast("long").alias("b"), "token", "pos", "size", "need")
    placed = listed.select("id", "key", "before", F.posexplode(F.split(F.trim(words_line(F.col("text"))), " ")).alias("i", "token")).join(ranked, "token")
    block = F.floor((F.col("before") + F.col("i")) / F.col("n"))
    in_windows = placed.select("id", "key", "name", F.lit(-1).cast("long").alias("a"), F.explode(F.array(block, block - 1)).alias("b"), "token", "pos", "size", "need").where("b >= 0")
    hits = in_lines.unionByName(in_windows).groupBy("id", "key", "name", "a", "b", "size", "need")
    # The template's tokens that a block holds are bits, by their place in the order.
    marks = range(-(-max(map(len, tokens_of.values())) // 60))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 60).cast("int"))
    hits = hits.agg(F.min("pos").alias("first"), *[F.bit_or(F.when(F.floor(F.col("pos") / 60) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"held{i}") for i in marks])
    hits = hits.withColumn("common", sum((F.bit_count(f"held{i}") for i in marks), F.lit(0)))
    hits = hits.where((F.col("first") <= F.col("size") - F.col("need")) & (F.col("common") >= F.col("need")))
    return hits.groupBy("id", "key", F.substring_index("name", "#", 1).alias("label")).agg(F.max(F.col("common") / F.col("size")).alias("score"))


def _ascii_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def _phrases(rows: DataFrame) -> DataFrame:
    """`id, key, n_words, at, base` of lines of words: the places of phrases that start in the first `own` words (all, if null), counted on from `before`."""
    hit = F.lit(False)
    for phrase in PHRASES:
        hit = hit | F.contains("line", F.lit(f" {phrase} "))
    rows = rows.select("id", "key", "before", F.coalesce("own", _n_words(F.col("line")).cast("long")).alias("n_words"), F.when(hit, F.col("line")).alias("line"))
    places = {label: F.when(F.col("line").isNotNull(), F.transform(phrase_places(F.col("line"), phrase), lambda i: i.cast("long"))) for phrase, label in PHRASES.items()}
    rows = rows.select("id", "key", "before", "n_words", *[F.coalesce(p, F.array().cast("array<long>")).alias(label) for label, p in places.items()])
    rows = rows.select("id", "key", "before", "n_words", *[F.filter(label, lambda i: i < F.col("n_words")).alias(label) for label in places])
    at = F.transform(F.concat(*[F.col(x) for x in places]), lambda i: i + F.col("before"))
    return rows.select("id", "key", "n_words", at.alias("at"), F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in sorted(places)]), lambda x: x.isNotNull()).alias("base"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, long_text: int | None = None) -> DataFrame:
    """Base phrases and template matches of every whole text, one row per input row.

    `n_base`, `first_word`, `last_word` and `base_labels` are of the phrases. `labels` adds the
    templates' labels; `score` is 1 with a phrase, else the best containment, else 0. Null and
    empty texts have no words. Each row has the labels of its own text, whether its id is
    repeated or null.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(text.cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))
    # Whole texts are read for the phrases once, and their small rows kept.
    short = rows.where(~is_long(F.col("text"), long_text)).select("id", "key", words_line(F.col("text")).alias("line"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("own"))
    base = stage(_phrases(short), "license-base")
    longer = stage(rows.where(is_long(F.col("text"), long_text)).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    if longer.limit(1).count():
        parts = pieces(longer.select("row", "text"), ["row"], SPLIT, long_text).withColumn("words", F.filter(F.split(F.trim(words_line(F.col("text"))), " "), lambda x: x != ""))
        most = max(len(p.split()) for p in PHRASES) - 1
        held = with_next(parts.select("row", "part", "words"), ["row"], "words", most)
        line = F.concat(F.lit(" "), F.array_join(F.concat("words", "after"), " "), F.lit(" "))
        each = _phrases(held.select(F.col("row").alias("id"), F.lit("").alias("key"), line.alias("line"), "before", F.size("words").cast("long").alias("own")))
        whole = each.groupBy(F.col("id").alias("row")).agg(F.sum("n_words").alias("n_words"), F.flatten(F.collect_list("at")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("base")))).alias("base"))
        none = F.array()
        whole = longer.select("id", "key", "row").join(whole, "row", "left").select("id", "key", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("at", none.cast("array<long>")).alias("at"), F.coalesce("base", none.cast("array<string>")).alias("base"))
        base = base.unionByName(stage(whole, "long-base"))
    rows = base
    matches = template_matches(docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text")), containment, long_text)
    matches = matches.groupBy(F.col("id").alias("m_id"), F.col("key").alias("m_key")).agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    out = rows.join(matches, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
