"""License scan by exact set-similarity join, DataFrame functions only.

A text's blocks are its runs of ``BLOCK`` words, every ``STEP`` words, and its last words; a notice of up to
``BLOCK - STEP`` words stands whole in one of them. A template matches a block that contains at least ``THRESHOLD`` of
its distinct words. Words are ordered by their document frequency over the whole corpus, rarest first; a block and a
template can only match when they share a word of both prefixes (prefix filter), when the block has words enough (length
filter) and when enough words are left behind the first shared one (positional filter). Survivors are verified, so no
matching block is missed and none is reported that does not match. Templates are a fixed list, so their side is
broadcast.

Besides, base phrases are found at every place where their words stand consecutively.

Defined cases: null text is empty text (no words, no labels, score 0); rows that repeat give a row each; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage, text_of, with_row_id

BLOCK = 64
STEP = 32
THRESHOLD = 0.9
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and their labels, as words. Fixed values.
TEMPLATES = [
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license apache"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> tuple[Column, Column]:
    """(joined, words): words in lower case, joined by single blanks; no word at all gives '' and ['']."""
    joined = F.trim(F.regexp_replace(ascii_lower(text), NO_WORD, " "))
    return joined, F.split(joined, " ")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(phrase: str) -> Column:
    """Starts of a phrase among ``words``; only texts that hold it are walked."""
    parts = phrase.split(" ")
    found = F.filter(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - len(parts))),
        lambda i: F.slice("words", i + 1, len(parts)) == _strings(parts),
    )
    # Not walked: an empty array, by a filter that nothing passes.
    none = F.filter(F.array(F.lit(0)), lambda i: i < 0)
    return F.when(F.contains(F.col("padded"), F.lit(f" {phrase} ")), found).otherwise(none)


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(uid, doc_id, n_words, n_base, first_word, last_word, base, known, words); ``known`` are the distinct template
    words of the text, ``words`` its words where they can hold a whole template, else null. To be staged."""
    vocabulary = sorted({w for _, t in templates for w in t.split(" ")})
    joined, _ = words_of(text_of(docs))
    rows = with_row_id(docs.select(docs["doc_id"], joined.alias("joined")), "uid")
    rows = rows.select(
        "uid", "doc_id", F.split("joined", " ").alias("words"), F.concat(F.lit(" "), "joined", F.lit(" ")).alias("padded")
    )
    rows = rows.select("*", F.array_intersect("words", _strings(vocabulary)).alias("known"))
    rows = rows.select("*", *[_places(p).alias(f"places{k}") for k, p in enumerate(PHRASES)])
    places = F.concat(*[F.col(f"places{k}") for k in range(len(PHRASES))])
    can = F.lit(False)
    for _, t in templates:
        own = sorted(set(t.split(" ")))
        need = math.ceil(threshold * len(own) - 1e-9)
        can = can | ((F.size("known") >= need) & (F.size(F.array_intersect("known", _strings(own))) >= need))
    base = F.array_compact(
        F.array(*[F.when(F.size(f"places{k}") > 0, F.lit(v)) for k, v in enumerate(PHRASES.values())])
    )
    return rows.select(
        "uid",
        "doc_id",
        F.when(F.col("padded") == "  ", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        base.alias("base"),
        "known",
        F.when(can, F.col("words")).alias("words"),
    )


def word_order(rows: DataFrame) -> list[str]:
    """Template words, rarest in the corpus first; at most one row for each word of the fixed templates."""
    counts = rows.select(F.explode("known").alias("word")).groupBy("word").count()
    return [r["word"] for r in sorted(counts.collect(), key=lambda r: (r["count"], r["word"]))]


def matched_blocks(
    rows: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(uid, block, template, label, begin, share) for every block that meets the threshold; ``rows`` is staged."""
    spark = rows.sparkSession
    seen = word_order(rows)
    rank = {w: k for k, w in enumerate(seen)}
    entries, needs = [], []
    for t, (label, text) in enumerate(templates):
        # Words that no document has come first: they are the rarest.
        own = sorted(set(text.split(" ")), key=lambda w: (rank.get(w, -1), w))
        need = math.ceil(threshold * len(own) - 1e-9)
        needs.append(need)
        entries += [(t, label, w, i, len(own), need, own) for i, w in enumerate(own[: len(own) - need + 1])]
    least = min(needs)
    prefixes = spark.createDataFrame(
        entries, "template int, label string, word string, i int, size int, need int, own array<string>"
    )
    blocks = (
        rows.filter("words is not null")
        .select(
            "uid",
            "words",
            F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1 - (BLOCK - STEP)), F.lit(STEP))),
        )
        .select(
            "uid",
            F.col("pos").alias("block"),
            F.col("col").alias("begin"),
            # In corpus order: the intersection keeps the order of its first side.
            F.array_intersect(_strings(seen or [""]), F.slice("words", F.col("col") + 1, BLOCK)).alias("tokens"),
        )
        .filter(F.size("tokens") >= least)
    )
    shared = blocks.select(
        "*", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)).alias("j", "word")
    ).join(F.broadcast(prefixes), "word")
    candidates = (
        shared.filter(F.size("tokens") >= F.col("need"))
        .groupBy("uid", "block", "begin", "template", "label", "size", "need")
        .agg(F.min(F.struct("i", "j")).alias("first"), F.first("tokens").alias("tokens"), F.first("own").alias("own"))
        .filter(1 + F.least(F.col("size") - F.col("first.i") - 1, F.size("tokens") - F.col("first.j") - 1) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("tokens", "own"))
    return candidates.filter(overlap >= F.col("need")).select(
        "uid", "block", "template", "label", "begin", (overlap / F.col("size")).alias("share")
    )


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best share
    of a template; 1 where a base phrase stands)."""
    rows = stage(scanned(docs, templates, threshold), "licenses")
    found = (
        matched_blocks(rows, templates, threshold)
        .groupBy("uid")
        .agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    )
    labels = F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_union("base", "found"))
    return rows.drop("words", "known").join(found, "uid", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
