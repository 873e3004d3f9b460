"""License scans in DataFrame operations only.

Templates and texts are cut to 5-word shingles. A template of L words is sought in windows of 1.5 L words at every
L / 2 words, so an occurrence lies whole in a window, and the window's Jaccard similarity to the template has a known
lower bound. Single-row MinHash bands, as many as make a miss less likely than MISS, retrieve the templates of a
window by an equi-join; exact shingle containment then verifies each match.

Before that, anchors are derived from the templates: words such that whoever holds `containment` of a template's
shingles holds one of them. Documents and windows without an anchor cannot match and cost a substring search. The words
of a document are cut to chunks of CHUNK window starts, each a row with the words its windows reach, so only the windows
of one chunk, and of those only the ones around anchors, exist at a time.

What is joined is broadcast: the bands of the templates, which are parameters and not data (MAX_TEMPLATES). A
document is matched by itself; only matches are shuffled, after partial aggregation.

Defined results: null, empty and short texts match nothing; documents without a match have no row; rows that share a
doc_id (a null one too) give one row, in which windows at the same word count once; a very long text is scanned whole,
chunk by chunk, in memory linear in it; a window that matches several templates counts for each; an empty table gives
no rows; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 80  # percent
MISS = 1e-6
MAX_TEMPLATES = 10_000
#: Words of a document at which the windows of one row may start.
CHUNK = 1024

# Statements by which texts name their license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def layout(length: int) -> tuple[int, int]:
    """(window, stride) in words for templates of a length."""
    stride = max(1, length // 2)
    return length + stride, stride


def anchors(templates: Sequence[tuple[str, str]], containment: int = CONTAINMENT) -> list[str]:
    """Words one of which stands in any set that holds `containment` percent of a template's shingles; long and
    widely used ones first."""
    open_sets = []
    for _, text in templates:
        w = template_words(text)
        grams = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        open_sets.append((grams, math.ceil(len(grams) * containment / 100)))
    chosen: list[str] = []
    while open_sets := [(g, need) for g, need in open_sets if len(g) >= need]:
        votes = Counter(w for g, _ in open_sets for gram in g for w in set(gram))
        best = max(votes, key=lambda w: (votes[w] * min(len(w), 8) ** 2, w))
        chosen.append(best)
        open_sets = [({gram for gram in g if best not in gram}, need) for g, need in open_sets]
    return chosen


def bands(lengths: Sequence[int], containment: int = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one row each, so that a window that holds a template is missed with probability `miss` at most."""
    least = 1.0
    for n in lengths:
        t, w = n - SHINGLE + 1, layout(n)[0] - SHINGLE + 1
        hit = math.ceil(t * containment / 100)
        least = min(least, hit / (w + t - hit))
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))


def _folded(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), _CAPITALS, _SMALL)


def _shingles(words: Column) -> Column:
    """Distinct hashes of the 5-word shingles of an array of words; none if it is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column, n: int, seed: int) -> Column:
    """The least shingle hash under each of n seeded orders, keyed with the order's number."""
    orders = F.sequence(F.lit(seed), F.lit(seed + n - 1))
    return F.transform(orders, lambda i: F.xxhash64(i, F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, i)))))


def _templates(spark: SparkSession, templates: Sequence[tuple[str, str]], n: int, seed: int) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, template_words(text))).alias("words")) for name, text in templates))
    table = spark.range(1).select(F.inline(rows)).withColumn("length", F.size("words")).withColumn("wanted", _shingles(F.col("words")))
    return table.select("license", "length", "wanted", F.explode(_bands(F.col("wanted"), n, seed)).alias("band"))


def scan_licenses(documents: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), containment: int = CONTAINMENT, text: str = "text", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """key, license, n_windows (windows that hold the template) and first_word (of the first such window) for each
    document and template matched. Templates need five words at least."""
    lengths = sorted({len(template_words(t)) for _, t in templates})
    if not templates or lengths[0] < SHINGLE or len(templates) > MAX_TEMPLATES:
        raise ValueError(f"templates: 1 to {MAX_TEMPLATES}, of {SHINGLE} words or more")
    found, n = anchors(templates, containment), bands(lengths, containment)
    hint = F.lit(False)
    for a in found:
        hint = hint | F.contains(F.col("folded"), F.lit(a))
    texts = documents.select(F.col(key).alias("key"), _folded(text).alias("folded")).where(hint)
    texts = texts.select("key", F.filter(F.split("folded", _SEPARATORS), lambda w: w != "").alias("words"))
    reach = CHUNK + max(layout(length)[0] for length in lengths)
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = texts.select("key", F.inline(F.transform(begins, lambda b: F.struct(b.alias("base"), F.slice("words", b + 1, reach).alias("own")))))
    wanted = F.array(*map(F.lit, found))
    hits = F.filter(F.transform("own", lambda w, i: F.when(F.array_contains(wanted, w), i)), lambda i: i.isNotNull())
    hit = chunks.withColumn("hits", F.transform(hits, lambda i: F.col("base") + i)).where(F.size("hits") > 0)

    def windows(length: int) -> Column:
        """The windows that start in the chunk and hold an anchor."""
        size, stride = layout(length)
        numbers = F.transform("hits", lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / stride)).cast("int"), F.floor(p / stride).cast("int")))
        starts = F.transform(F.array_distinct(F.flatten(numbers)), lambda k: k * stride)
        own = F.filter(starts, lambda s: (s >= F.col("base")) & (s < F.col("base") + CHUNK))
        return F.transform(own, lambda s: F.struct(F.lit(length).alias("length"), s.alias("first_word"), F.slice("own", s - F.col("base") + 1, size).alias("window")))

    cut = hit.select("key", F.inline(F.concat(*map(windows, lengths)))).withColumn("shingles", _shingles(F.col("window"))).where(F.size("shingles") > 0)
    probes = cut.select("key", "length", "first_word", "shingles", F.explode(_bands(F.col("shingles"), n, seed)).alias("band"))
    held = probes.join(F.broadcast(_templates(documents.sparkSession, templates, n, seed)), ["length", "band"])
    sure = held.where(100 * F.size(F.array_intersect("shingles", "wanted")) >= containment * F.size("wanted"))
    return sure.groupBy(F.col("key").alias(key), "license").agg(F.count_distinct("first_word").alias("n_windows"), F.min("first_word").cast("bigint").alias("first_word"))


def oracle_sql(templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), containment: int = CONTAINMENT) -> str:
    """scan_licenses(documents) for DuckDB: containment in every window, without bands or anchors."""
    values = []
    for name, text in templates:
        w = template_words(text)
        size, stride = layout(len(w))
        values += [f"('{name}', {size}, {stride}, '{' '.join(g)}')" for g in sorted({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})]
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(SHINGLE))
    return rf"""
WITH t(license, size, stride, gram) AS (VALUES {", ".join(values)}),
 wanted AS (SELECT license, count(*) AS n FROM t GROUP BY license),
 split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 grams AS (SELECT doc_id, i - 1 AS pos, {grams} AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS i FROM split WHERE len(w) >= {SHINGLE})),
 hits AS (SELECT doc_id, license, size, stride, gram, pos FROM grams JOIN t USING (gram)),
 placed AS (SELECT doc_id, license, gram, k * stride AS first_word FROM (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((pos + {SHINGLE} - size) / CAST(stride AS DOUBLE)) AS BIGINT)), pos // stride)) AS k FROM hits)),
 held AS (SELECT doc_id, license, first_word FROM placed GROUP BY doc_id, license, first_word HAVING 100 * count(DISTINCT gram) >= {containment} * (SELECT n FROM wanted WHERE wanted.license = placed.license))
SELECT doc_id, license, count(*) AS n_windows, min(first_word) AS first_word FROM held GROUP BY doc_id, license
"""
