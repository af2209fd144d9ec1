"""License scans by exact set-similarity join (DataFrame operations only).

A template is the token set of a licence notice. A text meets it where some run of 1 / THRESHOLD times as many words as the
notice has, whatever line breaks and comment marks stand between them, holds at least THRESHOLD of its tokens. Only words
of the templates can count, so a text is reduced to its marks, the places of those words, in one pass. A text block is a
stretch of STRIDE marks and as many behind them as the longest run can hold, so every run lies in one block.

Template tokens are ordered by how often the corpus holds them, rarest first. A block that meets a template must hold one
of its first n - ceil(THRESHOLD * n) + 1 tokens (prefix filter), must itself have enough tokens (length filter), and its
first common token must leave enough template tokens behind it (positional filter); what passes is counted run by run.
Phrases are found beside it, as marks on consecutive places.

Scale: texts are read once, and only marks leave the scan, in a file with a number for each row; blocks, counts and joins
read that. Blocks have a bounded size and are joined to a broadcast table of at most MAX_TEMPLATES * template length rows.
The only shuffles are the token counts (at most the template vocabulary per task) and the labels met, grouped by row number
with map-side partial sets.

Defined cases: null text is empty: no words, no labels, score 0; every input row is one result row with its own labels,
whether or not it shares an id, or has none; documents of any length are taken whole; ties do not matter, as sets and
minima are reported; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices as they stand in published texts, and their labels.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
)
THRESHOLD, MAX_TEMPLATES, STRIDE = 0.8, 1000, 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def template_sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int]]:
    """label, distinct tokens, how many of them are needed, and in how many words."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    sets = [(label, text.split(), list(dict.fromkeys(text.split()))) for text, label in templates]
    return [(label, tokens, max(1, math.ceil(round(threshold * len(tokens), 9))), math.ceil(round(len(words) / threshold, 9))) for label, words, tokens in sets]


def marked_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words, marked: place and word of every word of the vocabulary. docs: doc_id, text."""
    words = docs.select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("w"))
    places = F.filter(F.transform("w", lambda x, i: F.when(x.isin(vocabulary), i)), lambda i: i.isNotNull())
    marked = F.transform(places, lambda i: F.struct(i.alias("place"), F.get("w", i).alias("word")))
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), marked.alias("marked"))


def phrase_places(marked: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split()

    def stands(m: Column, j: Column) -> Column:
        fits = m["word"] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            fits = fits & (F.get(marked, j + k)["word"] == part) & (F.get(marked, j + k)["place"] == m["place"] + k)
        return F.when(fits, m["place"])

    return F.filter(F.transform(marked, stands), lambda i: i.isNotNull())


def template_matches(marks: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """row, label, containment: one row per row of marks (row, marked) and label, the best run's containment."""
    sets = template_sets(templates, threshold)
    seen = dict(marks.select(F.explode("marked.word").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())  # at most the vocabulary
    rows = []
    for label, tokens, need, span in sets:
        ordered = sorted(tokens, key=lambda w: (seen.get(w, 0), w))
        rows += [(label, ordered, need, span, w, at) for at, w in enumerate(ordered[: len(tokens) - need + 1])]
    index = marks.sparkSession.createDataFrame(rows, "label string, tokens array<string>, need int, span int, token string, at int")
    probes = F.array(*map(F.lit, sorted({r[4] for r in rows})))
    least, longest = min(need for _, _, need, _ in sets), max(span for _, _, _, span in sets)
    stretches = F.transform(F.sequence(F.lit(0), F.size("marked") - 1, F.lit(STRIDE)), lambda i: F.slice("marked", i + 1, STRIDE + longest - 1))
    blocks = marks.filter(F.size("marked") >= least).select("row", F.explode(stretches).alias("block")).withColumn("held", F.array_distinct("block.word"))
    hits = blocks.withColumn("hit", F.array_intersect("held", probes)).filter(F.size("hit") > 0).select("row", "block", "held", F.explode("hit").alias("token"))
    found = hits.join(F.broadcast(index), "token").filter("size(held) >= need and size(tokens) - at >= need")
    common = F.array_intersect("tokens", "held")
    found = found.filter((F.get(common, F.lit(0)) == F.col("token")) & (F.size(common) >= F.col("need")))  # each block and template once
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  (value is worked out once)
    ahead = lambda own, s, j: F.filter(F.slice(own, j + 1, F.col("span")), lambda x: x["place"] < s["place"] + F.col("span"))
    most = let(F.filter("block", lambda s: F.array_contains("tokens", s["word"])), lambda own: F.array_max(F.transform(own, lambda s, j: F.size(F.array_distinct(F.transform(ahead(own, s, j), lambda x: x["word"]))))))
    met = found.withColumn("most", most).filter("most >= need")
    return met.groupBy("row", "label").agg(F.max(F.col("most") / F.size("tokens")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per input row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = sorted({w for _, tokens, _, _ in template_sets(templates, threshold) for w in tokens} | {w for p, _ in PHRASES for w in p.split()})
    marks = cut(marked_words(own, vocabulary).withColumn("row", F.monotonically_increasing_id()), "license-marks")
    by_row = template_matches(marks, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    counted = marks.select("row", "doc_id", "n_words", *[phrase_places(F.col("marked"), p).alias(f"at{i}") for i, (p, _) in enumerate(PHRASES)])
    labels = F.filter(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    base = counted.select("row", "doc_id", "n_words", F.concat(*[f"at{i}" for i in range(len(PHRASES))]).alias("at"), labels.alias("base"))
    both = base.join(by_row, "row", "left")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return both.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
