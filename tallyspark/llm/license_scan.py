"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations.

A text's blocks are windows of ``BLOCK`` words, or of more for longer templates, one every half block. A block matches a
template when it holds at least ``percent`` of the template's distinct words. Template words are
put in one global order, rare in the corpus before frequent. A matching block then holds one of
the few first words of the template in this order (prefix filter), has enough template words at
all (length filter), and enough of them from the word that met on (positional filter); only
blocks that pass are verified. Base phrases are templates that must be held whole; their places
are then read off the words of the blocks that match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of a block at least; it grows until no template is longer than half of it.
BLOCK = 64
#: What separates words, as a class of Java and RE2.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences of public licenses and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "this software is released under the terms of the mit license": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this library is free software licensed under the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved unauthorized copying of this work is strictly prohibited": "proprietary",
}


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.words)))

    def need(self, percent: int) -> int:
        return len(self.tokens) if self.base else -(-percent * len(self.tokens) // 100)


def templates(base: dict[str, str] = BASE, extra: dict[str, str] = TEMPLATES) -> list[Template]:
    out = [Template(tuple(k.split()), v, True) for k, v in base.items()] + [Template(tuple(k.split()), v, False) for k, v in extra.items()]
    return out


def words_of(text: Column) -> Column:
    """The text's words, A-Z in lower case and no other letter changed."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def corpus_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words by their frequency in all texts, rare first; ties by the word."""
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in seen.collect()}  # as many rows as the templates have words
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan_licenses(docs: DataFrame, percent: int = 80, known: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the license labels of its blocks.

    ``n_base``, ``first_word`` and ``last_word`` count and bound the places where a base phrase
    stands word for word; ``labels`` adds those of the templates that a block contains to at
    least ``percent``; ``score`` is the best containment, 0 without any; ``blocks`` counts the
    matching (block, template) pairs. A null text counts as empty: no words, null places, empty
    labels. Repeated rows and null ids keep a row each; other columns are not read.
    """
    known = known if known is not None else templates()
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    order = corpus_order(texts, sorted({w for t in known for w in t.tokens}))
    rank = {w: k for k, w in enumerate(order)}
    session = texts.sparkSession

    # One row per prefix word of each template: a table as small as the templates.
    rows = []
    for number, t in enumerate(known):
        ranks, need = sorted(rank[w] for w in t.tokens), t.need(percent)
        rows += [(order[r], number, place, need, ranks, list(t.words), t.label, t.base) for place, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = F.broadcast(session.createDataFrame(rows, "token string, template int, place int, need int, ranks array<int>, phrase array<string>, label string, base boolean"))
    first_words = sorted({r[0] for r in rows})
    ranks_of = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])]) if order else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))

    half = max([BLOCK // 2, *(len(t.words) for t in known)])
    counted = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(first_words), i)), lambda i: i.isNotNull())
    # A hit lies in the block that starts at its half block and in the one before; a text with none keeps one empty block.
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(F.greatest(F.lit(0), (F.floor(i / half) - 1) * half), F.floor(i / half) * half))))
    blocks = counted.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", starts.alias("starts"))
    blocks = blocks.select("row", "doc_id", "n_words", F.explode_outer(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("words", (s + 1).cast("int"), 2 * half).alias("words")))).alias("block"))
    blocks = blocks.select("row", "doc_id", "n_words", "block.start", F.col("block.words").alias("words"))
    blocks = blocks.withColumn("held", F.array_sort(F.array_distinct(F.filter(F.transform(F.filter("words", lambda w: w.isin(order)), lambda w: F.element_at(ranks_of, w)), lambda r: r.isNotNull()))))
    # The join: prefix, length and positional filters, then exact containment; rows without a partner stay.
    met = blocks.select("*", F.explode_outer(F.array_intersect("words", F.lit(first_words).cast("array<string>"))).alias("token")).join(prefixes, "token", "left")
    at = F.array_position("held", F.element_at("ranks", F.col("place") + 1)) - 1
    after = F.least(F.size("ranks") - F.col("place") - 1, F.size("held") - at - 1)
    inside, n = F.size(F.array_intersect("held", "ranks")), F.size("phrase")
    passed = F.col("template").isNotNull() & (F.size("held") >= F.col("need")) & (1 + after + F.least(F.col("place"), at) >= F.col("need")) & (inside >= F.col("need"))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.slice("words", i + 1, n) == F.col("phrase"), F.col("start") + i)), lambda i: i.isNotNull())
    met = met.select("row", "doc_id", "n_words", "start", "template", "label", "base", F.when(passed, inside / F.size("ranks")).alias("containment"), F.when(passed & F.col("base"), places).alias("places"))
    good = F.col("containment").isNotNull() & (~F.col("base") | (F.size("places") > 0))
    pair = F.when(good, F.struct("start", "template"))
    named = F.when(good & F.col("base"), F.transform("places", lambda p: F.struct(p.alias("place"), F.col("template").alias("phrase"))))
    whole = met.groupBy("row", "doc_id", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list(named))).alias("places"),
        F.collect_set(F.when(good & F.col("base"), F.col("label"))).alias("base_set"),
        F.collect_set(F.when(good, F.col("label"))).alias("label_set"),
        F.max(F.when(good, F.col("containment"))).alias("score"),
        F.size(F.collect_set(pair)).alias("blocks"),
    )
    joined = lambda c: F.concat_ws(",", F.array_sort(c))
    return whole.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.place").cast("long").alias("first_word"),
        F.array_max("places.place").cast("long").alias("last_word"),
        joined("base_set").alias("base_labels"),
        joined("label_set").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("blocks").cast("long").alias("blocks"),
    )


def oracle() -> str:
    """The same rows by plain SQL: every block against every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"({k}, {quoted(t.words)}, {quoted(t.tokens)}, {t.need(80)}, '{t.label}', {t.base})" for k, t in enumerate(templates()))
    return f"""
WITH t(id, phrase, tokens, need, label, base) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
b AS (SELECT doc_id, s AS start, words[s + 1 : s + {BLOCK}] AS words FROM (SELECT doc_id, words, unnest(range(0, len(words), {BLOCK // 2})) AS s FROM w)),
p AS (SELECT DISTINCT b.doc_id, t.id, b.start + i AS place, b.start
      FROM (SELECT *, unnest(range(0, len(words))) AS i FROM b) b JOIN t ON t.base AND b.words[i + 1] = t.phrase[1] AND b.words[i + 1 : i + len(t.phrase)] = t.phrase),
m AS (SELECT b.doc_id, b.start, t.id, t.label, t.base, len(list_intersect(list_distinct(b.words), t.tokens)) AS inside, len(t.tokens) AS size
      FROM b, t WHERE inside >= t.need AND (NOT t.base OR EXISTS (SELECT 1 FROM p WHERE p.doc_id = b.doc_id AND p.id = t.id AND p.start = b.start))),
g AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(inside::DOUBLE / size) AS score, count(*) AS blocks FROM m GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT (id, place)) AS n_base, min(place) AS first_word, max(place) AS last_word FROM p GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(blocks, 0) AS blocks
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN q USING (doc_id)"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
