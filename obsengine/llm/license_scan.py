"""License scans: an exact set-similarity join between blocks of text and license templates.

A block matches a template if it holds at least `threshold` of the template's different words. Words are ordered by how often
they occur in all documents, rarest first, counted by Spark. In that order, if a block and a template share the
`need` words that the threshold asks for, then the first word that they share is one of the first k - need + 1 of the template's k words,
and one of the first b - need + 1 of the block's b. So
* a template is indexed under the words of its prefix only, and a block looks up only its own words (prefix filter);
* a block of fewer than `need` words of any template is left out (length filter);
* a pair whose first shared word is too late in either for `need` words to be left is left out (position filter).
What remains is compared word by word. No pair at or over the threshold is lost.

Blocks: for a template of m words, stretches of `width` words, the smallest power of two of at least 2 m (8 at least), that start at
each multiple of width / 2. So any passage of up to width / 2 words, a template's own text too, stands whole in a block.
Words that are in no template can't be shared, so blocks go without them.

Spark counts the words (combined in the tasks), and joins the words of blocks with the index of prefixes; the index, and the
ranks of the templates' words, are small, with a checked bound. Blocks without a word of any prefix never leave the task that reads the text.

Defined cases: a null or empty text has no words and no labels (empty strings) and a score of 0; repeated rows are scanned each; ties in frequency are
in order of the words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import map_rows, require_small, staged

THRESHOLD = 0.8
MOST_WORDS = 20_000  # of all templates
#: Phrases whose places are reported one by one. They are templates as well.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    *PHRASES,
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]
Templates = list[tuple[str, str]]
#: A-Z become a-z, other ASCII that is no digit or letter becomes a space; what is beyond ASCII stays.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def width_of(words: int) -> int:
    return max(8, 1 << (2 * words - 1).bit_length())


def needed(words: int, threshold: float) -> int:
    """How many of a template's different words a block must hold."""
    return max(1, math.ceil(words * threshold - 1e-9))


def frequencies(docs: DataFrame, vocabulary: set[bytes], text_column: str = "text") -> DataFrame:
    """(word, n): how often each word of the vocabulary occurs in all texts. Summed in each slice before it is shuffled."""

    def run(part: dict[str, list]) -> dict[str, list]:
        found: Counter[bytes] = Counter()
        for text in part["text"]:
            found.update(filter(vocabulary.__contains__, words_of(text)))
        return {"word": [w.decode() for w in found], "n": list(found.values())}

    counts = map_rows(docs.select(F.col(text_column).alias("text")), run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def index(templates: Templates, rank: dict[bytes, int], threshold: float) -> list[tuple[int, str, int, int, list[int]]]:
    """(template, label, width, need, words by rank) of each template that has a word."""
    out = []
    for n, (label, text) in enumerate(templates):
        words = words_of(text)
        if words:
            ordered = sorted({rank[w] for w in words})
            out.append((n, label, width_of(len(words)), needed(len(ordered), threshold), ordered))
    return out


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand one after the other."""
    joined, sought, at, out = b" %b " % b" ".join(words), b" %b " % b" ".join(phrase), -1, []
    while (at := joined.find(sought, at + 1)) >= 0:
        out.append(joined.count(b" ", 0, at))
    return out


def scanned(docs: DataFrame, phrases: Templates, indexed: list[tuple[int, str, int, int, list[int]]], rank: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, blocks) of each text, a narrow map.

    Blocks, as (width, block, words by rank), are those with a word of a prefix and enough words for a template of their width.
    """
    sought = [(label, words_of(text)) for label, text in phrases]
    prefixes: dict[int, set[int]] = defaultdict(set)
    known: dict[int, set[int]] = defaultdict(set)
    least: dict[int, int] = {}
    for _, _, width, need, ordered in indexed:
        prefixes[width].update(ordered[: len(ordered) - need + 1])
        known[width].update(ordered)
        least[width] = min(need, least.get(width, need))
    rare = {w for w, r in rank.items() if any(r in p for p in prefixes.values())}
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def blocks(words: list[bytes]) -> list[dict]:
        hits = [(i, rank[w]) for i, w in enumerate(words) if w in rare]
        out = []
        for width, prefix in prefixes.items():
            half = width // 2
            found = {b for i, r in hits if r in prefix for b in (i // half, i // half - 1) if b >= 0}
            for b in sorted(found):
                held = sorted({r for w in words[b * half : b * half + width] if (r := rank.get(w)) is not None and r in known[width]})
                if len(held) >= least[width]:
                    out.append({"width": width, "block": b, "words": held})
        return out

    def run(part: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": part["doc_id"], "n_words": [], "n_base": [], "first_word": [], "last_word": [], "base": [], "blocks": []}
        for text in part["text"]:
            words = words_of(text)
            at = {label: places(words, phrase) for label, phrase in sought}
            starts = [i for found in at.values() for i in found]
            out["n_words"].append(len(words))
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base"].append([label for label, found in at.items() if found])
            out["blocks"].append(blocks(words))
        return out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<width: int, block: long, words: array<int>>>"
    return map_rows(rows, run, schema, 64)


def matches(texts: DataFrame, indexed: list[tuple[int, str, int, int, list[int]]]) -> DataFrame:
    """(row, template, label, first_word, width, containment): all blocks of `texts` (row, blocks) that hold enough of a template's words."""
    templates = texts.sparkSession.createDataFrame(indexed, "template int, label string, width int, need int, own array<int>")
    prefix = F.slice("own", F.lit(1), F.size("own") - F.col("need") + 1)
    keys = templates.select("*", F.posexplode(prefix).alias("i", "word"))
    blocks = texts.select("row", F.inline("blocks")).withColumnRenamed("words", "held")
    probes = blocks.select("*", F.posexplode("held").alias("j", "word"))
    left = 1 + F.least(F.size("own") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    met = probes.join(F.broadcast(keys), ["width", "word"]).filter((F.size("held") >= F.col("need")) & (left >= F.col("need")))
    both = met.withColumn("both", F.array_intersect("held", "own")).filter(F.element_at("both", 1) == F.col("word"))  # each pair once, at its first word
    held = both.filter(F.size("both") >= F.col("need"))
    return held.select("row", "template", "label", (F.col("block") * F.expr("width div 2")).alias("first_word"), "width", (F.size("both") / F.size("own")).alias("containment"))


def licenses(docs: DataFrame, templates: Templates = TEMPLATES, phrases: Templates = PHRASES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: what `scanned` found for each text, with a number `row`; and the `matches` of their blocks."""
    vocabulary = {w for _, text in templates for w in words_of(text)}
    require_small(len(vocabulary), MOST_WORDS, "words of license templates")
    counted = {r.word.encode(): r.n for r in frequencies(docs, vocabulary, text_column).collect()}  # no more than the vocabulary
    rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    indexed = index(templates, rank, threshold)
    found = scanned(docs, phrases, indexed, rank, id_column, text_column)
    texts = staged(found.withColumn("row", F.monotonically_increasing_id()), "license-texts")
    return texts, matches(texts, indexed)


def labelled(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): score is the most that a block holds of a template."""
    texts, found = licenses(docs, **options)
    by_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return texts.join(by_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.coalesce("most", F.lit(0.0)).alias("score"),
    )


def oracle_sql(templates: Templates = TEMPLATES, phrases: Templates = PHRASES, threshold: float = THRESHOLD) -> str:
    """All blocks by all templates of their width."""
    shown = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    values, sizes = [], set()
    for label, text in templates:
        words = words_of(text)
        own = sorted(set(words))
        sizes.add(width_of(len(words)))
        values.append(f"('{label}', {width_of(len(words))}, {needed(len(own), threshold)}, {shown(own)})")
    sought = ", ".join(f"('{label}', {shown(words_of(text))})" for label, text in phrases)
    return rf"""
WITH t(label, width, need, own) AS (VALUES {", ".join(values)}), p(label, own) AS (VALUES {sought}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM
  (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(own)] = own)) AS i FROM d, p WHERE list_has_all(w, own)) GROUP BY r),
b AS (SELECT r, width, list_distinct(w[k * (width // 2) + 1:k * (width // 2) + width]) AS held FROM
  (SELECT r, w, width, unnest(range((len(w) + width // 2 - 1) // (width // 2))) AS k FROM d, (SELECT unnest([{", ".join(map(str, sorted(sizes)))}]) AS width))),
m AS (SELECT r, list(DISTINCT label) AS ls, max(n / len(own)) AS most FROM (SELECT r, label, own, need, len(list_intersect(held, own)) AS n FROM b JOIN t USING (width) WHERE list_has_any(held, own)) WHERE n >= need GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(m.ls, [])))), ',') AS labels, coalesce(most, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN m USING (r)"""


ORACLE_SQL = oracle_sql()
