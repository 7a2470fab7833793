"""License scans: an exact set-similarity join between text blocks and license templates.

Base labels stand for phrases whose words stand consecutively.  The method adds
the labels of templates: a block (of the words of the whole document, across its
lines, in windows of ``BLOCK`` words every ``BLOCK / 2``) meets a template if a
stretch of it holds at least ``containment`` of the template's distinct words.  A
stretch has at most as many words as the template divided by ``containment``, so
words scattered over a block are no template, and wrapped lines change nothing.
It also holds all of ``names`` that the template has (license names, versions, nc).

Words are ordered by how many documents hold them, rare ones first, counted
over all documents.  Of a template of ``t`` words of which ``need`` must occur,
one of the first ``t - need + 1`` has to (prefix filter); the block needs
``need`` template words at all (length filter), and what follows a common word
on both sides must suffice for the rest (positional filter).  What passes is
verified on the full sets, and then on the stretches.  The filters lose nothing, so the result is exact.

The templates are a parameter; only their words (counts and ranks) and index
are sent to all executors.

Defined cases: null text counts as empty: no words, no labels, score 0;
repeated rows get equal results; an empty table gives an empty table; further
columns are ignored.  The score is 1 if a base phrase occurs, else the largest
share of a template that a meeting stretch holds, else 0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .native import let, quoted

#: Fixed value: what is a word, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 64

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Labels and sentences by which license texts announce themselves.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: Fixed value: words that tell one license from another; a template that has some is met only with all of them.
NAMES = frozenset(["apache", "cc", "gnu", "mit", "mozilla", "nc", "2", "3"])


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", text.lower())))


def stretch_words(text: str, containment: float) -> int:
    """Words that a stretch has at most in which a template is looked for."""
    return math.ceil(len(re.findall("[a-z0-9]+", text.lower())) / containment - 1e-9)


def _array(values, kind: str) -> str:
    return f"cast(array({', '.join(values)}) as array<{kind}>)"


def _starts_sql(words: str, phrase: str) -> str:
    """Places (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    same = " AND ".join(f"{words}[i + {k}] = {quoted(p)}" for k, p in enumerate(parts))
    n = len(parts)
    return f"IF(size({words}) < {n} OR NOT array_contains({words}, {quoted(parts[0])}), cast(array() as array<int>), filter(sequence(0, greatest(size({words}) - {n}, 0)), i -> {same}))"


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES, containment: float = 0.8, names: frozenset[str] = NAMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.

    Texts are taken apart once: what is written to the shared folder of a
    document is its number of words, the places of base phrases, and ``marks``,
    the places of words that some template has.
    """
    spark = docs.sparkSession
    # lower() equals lower-casing A-Z for these ASCII words, but for the Kelvin sign, which would become a k
    low = F.lower(F.translate(F.coalesce(F.col(text_col), F.lit("")), "K", "é"))
    worded = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    known, listed = _array(map(quoted, vocabulary), "string"), ", ".join(map(quoted, vocabulary))
    starts = let("w", "words", f"array({', '.join(_starts_sql('w', phrase) for phrase in base)})")
    places = f"filter(sequence(0, size(words) - 1), i -> words[i] IN ({listed}))" if vocabulary else "cast(array() as array<int>)"
    marks = f"IF(size(words) = 0, cast(array() as array<int>), {places})"
    rows = worded.select(
        F.monotonically_increasing_id().alias("row"),  # stands in the table, so it stays as it is
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.expr(starts).alias("places"),
        F.expr(f"transform({marks}, i -> named_struct('p', i, 'w', cast(array_position({known}, words[i]) - 1 as int)))").alias("marks"),
    )
    rows = stash(rows, "licenses")

    held = rows.select(F.explode(F.expr("array_distinct(transform(marks, m -> m.w))")).alias("w")).groupBy("w").count()
    count = {vocabulary[r["w"]]: r["count"] for r in held.collect()}  # one row for each word of the templates at most
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index, prefixes = [], set()
    for number, (label, text) in enumerate(templates):
        ranks = sorted(rank[w] for w in template_words(text))
        need = math.ceil(containment * len(ranks) - 1e-9)
        stretch = stretch_words(text, containment)
        if stretch > BLOCK // 2 + 1:
            raise ValueError(f"a template of more words than blocks of {BLOCK} are sure to hold: {text!r}")
        for place in range(len(ranks) - need + 1):
            index.append((ranks[place], number, label, place, len(ranks), need, ranks, stretch, [r for r in ranks if order[r] in names]))
            prefixes.add(ranks[place])
    columns = "rank int, template int, label string, t_place int, t_size int, need int, t_ranks array<int>, stretch int, t_names array<int>"
    small = F.broadcast(spark.createDataFrame(index, columns))  # the size of the templates

    # blocks that hold a word of a prefix: each such word names the two blocks it lies in, but for those its predecessor named
    step = BLOCK // 2
    ranked = F.expr(f"transform(marks, m -> named_struct('p', m.p, 'r', {_array([str(rank[w]) for w in vocabulary], 'int')}[m.w]))")
    first = ", ".join(map(str, sorted(prefixes))) or "-1"
    anchors = F.expr(f"filter(transform(ranked, (m, j) -> named_struct('p', m.p, 'r', m.r, 'j', j)), m -> m.r IN ({first}))")
    some = rows.select("row", "n_words", ranked.alias("ranked")).withColumn("anchors", anchors).where("size(anchors) > 0")
    last = f"greatest(n_words - {step} - 1, 0) div {step}"
    before = f"IF(i = 0, -1, anchors[i - 1].p div {step})"
    blocks = F.expr(f"flatten(transform(anchors, (m, i) -> transform(filter(array(m.p div {step} - 1, m.p div {step}), k -> k >= 0 AND k <= {last} AND k > {before}), k -> named_struct('k', k, 'j', m.j))))")
    some = some.select("row", "ranked", F.explode(blocks).alias("b"))
    near = f"transform(sequence(greatest(b.j - {BLOCK - 1}, 0), least(b.j + {BLOCK - 1}, size(ranked) - 1)), z -> ranked[z])"
    sets = some.select("row", F.expr(f"filter({near}, m -> m.p >= b.k * {step} AND m.p < b.k * {step} + {BLOCK})").alias("block"))
    sets = sets.withColumn("ranks", F.expr("sort_array(array_distinct(transform(block, m -> m.r)))"))
    pairs = sets.select("row", "block", "ranks", F.posexplode("ranks").alias("place", "rank")).join(small, "rank")
    pairs = pairs.where("size(ranks) >= need AND 1 + least(t_size - t_place - 1, size(ranks) - place - 1) >= need")
    met = pairs.where("size(array_intersect(ranks, t_ranks)) >= need AND size(array_except(t_names, ranks)) = 0")
    # a stretch that holds the most begins at a marked word
    stretches = "transform(block, s -> transform(filter(block, m -> m.p >= s.p AND m.p < s.p + stretch), m -> m.r))"
    met = met.withColumn("common", F.expr(f"array_max(transform(filter({stretches}, s -> size(array_except(t_names, s)) = 0), s -> size(array_intersect(s, t_ranks))))")).where("common >= need")
    met = met.groupBy("row").agg(F.collect_set("label").alias("own_labels"), F.max(F.col("common") / F.col("t_size")).alias("own_score"))

    labels = _array(map(quoted, base.values()), "string")
    main = rows.select(
        "row",
        "id",
        "n_words",
        F.expr("flatten(places)").alias("starts"),
        F.expr(f"array_sort(array_distinct(filter(transform(places, (p, i) -> IF(size(p) > 0, {labels}[i], NULL)), x -> x IS NOT NULL)))").alias("base_found"),
    )
    return main.join(met, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_found", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base_found, coalesce(own_labels, cast(array() as array<string>))))), ',')").alias("labels"),
        F.expr("IF(size(starts) > 0, 1D, coalesce(own_score, 0D))").alias("score"),
    )
