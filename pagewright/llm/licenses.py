"""License scans: an exact set-similarity join of text blocks with license templates.

A text's blocks are BLOCK words long and start every STRIDE words, so every place of a phrase or
notice lies in one. Template words are ordered by how many texts of the whole corpus hold them, rarest
first. A block that holds `need` of a template's words must hold one of its first
size - need + 1 (prefix filter), have `need` template words at all (length filter) and, from the
shared word on, enough words left on both sides (positional filter). What passes is verified on
full sets; phrases, which need all their words, then also word by word in their order. Notices of different licenses may differ by one word,
less than the threshold forgives: what tells a notice from its neighbours has to be there as well (see `telling`).
DataFrame functions alone. A text is read once: its template words and their places are written, by chunks of STRIDE words, and
all else works on those. Only blocks near a prefix word leave their document's row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii, stash, table

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that the scan knows besides, by label.
TEMPLATES = {
    "all-rights-reserved": ["Copyright. All rights reserved."],
    "agpl": ["licensed under the GNU Affero General Public License version 3"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0 Universal"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "lgpl": ["licensed under the GNU Lesser General Public License"],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
}
PERCENT = 85
STRIDE = 64
BLOCK = 128
#: Words before lower-casing: the class of lower-cased words and A-Z.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def telling(notices: list[tuple[str, list[str], int]]) -> list[list[list[str]]]:
    """What a text has to hold so that a notice (label, words in order, how many suffice) isn't taken for one of another label; for each notice, runs of words.

    From a notice that has enough of its words, the words which that one lacks: "affero". From one that puts such a word of its own between
    two neighbouring words, those two side by side: "gnu general", as another says "gnu affero general".
    """

    def others(label: str) -> list[tuple[str, list[str], int]]:
        return [n for n in notices if n[0] != label]

    lacked = [{w for _, other, _ in others(label) if len(set(own) & set(other)) >= need for w in set(own) - set(other)} for label, own, need in notices]
    marks = {w for x in lacked for w in x}
    out = []
    for (label, own, _), words in zip(notices, lacked, strict=True):
        parted = {(a, b) for _, other, _ in others(label) for a, x, b in zip(other, other[1:], other[2:]) if x in marks - set(own)}
        out.append([[w] for w in sorted(words)] + sorted(map(list, parted & set(zip(own, own[1:])))))
    return out


def templates(notices: dict[str, list[str]], percent: int) -> list[dict]:
    """Phrases and notices: label, words in order (phrases), distinct words, how many of them a block needs, and the runs of words it must hold."""
    out = [{"label": label, "phrase": _words(p), "words": sorted(set(_words(p))), "need": len(set(_words(p))), "must": []} for p, label in PHRASES.items()]
    listed = []
    for label, texts in notices.items():
        for t in texts:
            if len(_words(t)) > STRIDE:
                raise ValueError(f"a template has {STRIDE} words at most: {label}")
            listed.append((label, _words(t), -(-len(set(_words(t))) * percent // 100)))
    for (label, w, need), must in zip(listed, telling(listed), strict=True):
        out.append({"label": label, "phrase": None, "words": sorted(set(w)), "need": need, "must": must})
    return out


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are ignored): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base: places where a phrase's words stand consecutively; first_word and last_word: the least and greatest of their
    starts, in words from 0, null without one. labels: those of phrases and of notices of which a block holds `percent` or more of
    the distinct words, and all that tells the notice from those of other labels. score: the largest containment found, 1 for a phrase, 0 where nothing is. Label lists are distinct, sorted and joined
    by commas. Null and empty texts have no words. Repeated rows come out once each; an empty table gives an empty result.
    """
    known = templates(TEMPLATES if notices is None else notices, percent)
    vocabulary = sorted({w for t in known for w in t["words"]})
    # the one pass over texts: of each chunk of STRIDE words, the template words with their places
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
    hit = lambda c: lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct((c * STRIDE + i).alias("i"), lower_ascii(w).alias("w")))
    chunks = F.transform(starts, lambda c: F.array_compact(F.transform(F.slice(F.col("words"), c * STRIDE + 1, STRIDE), hit(c))))
    # the key tells repeated rows apart; it is written, so it stays the same
    rows = stash(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.size("words").cast("long").alias("n_words"), chunks.alias("chunks")))

    # how many texts hold a template word
    held = F.array_distinct(F.transform(F.flatten("chunks"), lambda h: h["w"]))
    seen = rows.select(F.explode_outer(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.w: r.n for r in seen.where(F.col("w").isin(vocabulary)).collect()}  # one row a template word at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    for t in known:
        t["ranks"] = sorted(rank[w] for w in t["words"])
        t["prefix"] = t["ranks"][: len(t["ranks"]) - t["need"] + 1]
    by_rank = sorted(vocabulary, key=rank.get)
    probes = sorted({by_rank[r] for t in known for r in t["prefix"]})

    # a block is a chunk and the next; outer, as an inner explode would make the array twice, once to ask whether it is empty
    after = lambda b: F.coalesce(F.get("chunks", b + 1), F.array().cast("array<struct<i:int,w:string>>"))
    blocks = F.transform("chunks", lambda x, b: F.struct(b.alias("b"), F.concat(x, after(b)).alias("hits")))
    near = F.filter(blocks, lambda c: F.exists(c["hits"], lambda h: h["w"].isin(probes)))
    cells = rows.select("key", F.explode_outer(near).alias("x")).where("x is not null").select("key", "x.b", "x.hits")
    numbers = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    block = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    cells = cells.withColumn("ranks", F.array_sort(F.transform(F.filter(block, lambda w: w.isin(vocabulary)), lambda w: numbers[w])))
    spark = docs.sparkSession
    prefixes = [(r, k, p, len(t["ranks"]), t["need"]) for k, t in enumerate(known) for p, r in enumerate(t["prefix"])]
    prefixes = spark.createDataFrame(prefixes, "rank int, template int, p int, size int, need int")  # bounded by the templates
    probed = cells.select("key", "b", "hits", "ranks", F.posexplode("ranks").alias("q", "rank")).join(F.broadcast(prefixes), "rank")
    left = 1 + F.least(F.col("size") - F.col("p") - 1, F.size("ranks") - F.col("q") - 1)
    probed = probed.where((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
    # a block's prefix words may name a template more than once: its first prefix word counts, as any earlier one would be shared too
    full = F.array(*[F.array(*map(F.lit, t["ranks"])) for t in known])
    sets = F.array_intersect("ranks", F.get(full, F.col("template")))
    first = F.element_at(F.array_sort(sets), 1) == F.col("rank")
    pairs = probed.withColumn("shared", F.size(sets)).where(first & (F.col("shared") >= F.col("need")))
    phrases = F.array(*[F.array(*map(F.lit, t["phrase"] or [""])) for t in known])
    phrase = F.get(phrases, F.col("template"))
    n_phrases = len(PHRASES)
    place = lambda j: F.get("hits", j)["i"]
    last = F.size(phrase) - 1
    musts = F.array(*[F.array(*[F.array(*map(F.lit, m)) for m in t["must"]]).cast("array<array<string>>") for t in known])
    at = F.sequence(F.lit(0), F.size("hits") - 1)
    side_by_side = lambda m, j: (F.transform(F.slice("hits", j + 1, F.size(m)), lambda h: h["w"]) == m) & (place(j + F.size(m) - 1) - place(j) == F.size(m) - 1)
    told = F.forall(F.get(musts, F.col("template")), lambda m: F.exists(at, lambda j: side_by_side(m, j)))
    pairs = pairs.where(told)
    # a phrase's words are template words all, so they stand side by side among the hits too
    stands = lambda j: (F.transform(F.slice("hits", j + 1, last + 1), lambda h: h["w"]) == phrase) & (place(j + last) - place(j) == last)
    own = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda j: (place(j) < (F.col("b") + 1) * STRIDE) & stands(j))
    places = F.when(F.col("template") < n_phrases, F.transform(own, place))
    labels = F.array(*[F.lit(t["label"]) for t in known])
    base = F.col("template") < n_phrases
    pairs = pairs.select("key", base.alias("base"), F.get(labels, F.col("template")).alias("label"), (F.col("shared") / F.col("size")).alias("score"), places.alias("places"))
    pairs = pairs.where(~F.col("base") | (F.size("places") > 0))
    found = pairs.groupBy("key").agg(
        F.sum(F.when(F.col("base"), F.size("places")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.select("key", "doc_id", "n_words").join(found, "key", "left").drop("key").fillna(none)


def op1_license_set_similarity(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def words(w):
        return "[" + ", ".join(f"'{x}'" for x in w) + "]"

    known = templates(TEMPLATES, PERCENT)
    phrases = ", ".join(f"('{t['label']}', {words(t['phrase'])})" for t in known if t["phrase"])
    must = lambda t: "[" + ", ".join(f"' {' '.join(m)} '" for m in t["must"]) + "]::VARCHAR[]"
    notices = ", ".join(f"('{t['label']}', {words(t['words'])}, {t['need']}, {must(t)})" for t in known if not t["phrase"])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, ph) AS (VALUES {phrases}),
k(label, tw, need, must) AS (VALUES {notices}),
i AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM t),
h AS (SELECT doc_id, label, i FROM i, p WHERE w[i + 1] = ph[1] AND w[i + 1 : i + len(ph)] = ph),
b AS (SELECT doc_id, w[x + 1 : x + {BLOCK}] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS x FROM t)),
c AS (SELECT doc_id, label, len(list_intersect(list_distinct(w), tw)) / len(tw) AS score FROM b, k
  WHERE len(list_intersect(list_distinct(w), tw)) >= need AND len(list_filter(must, lambda m: NOT contains(' ' || array_to_string(w, ' ') || ' ', m))) = 0),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, 1.0::DOUBLE AS score FROM h UNION ALL SELECT * FROM c) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id)
"""


QUERIES = {"op1_license_set_similarity": op1_license_set_similarity}
ORACLES = {"op1_license_set_similarity": _oracle()}
