"""License scan by diagonal voting.

Texts are lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Templates are license notices, and
short phrases that must stand word by word. The steps:

1. Every rolling hash of GRAM words of every document is joined by Spark to its places in the templates, a broadcast
   table of fixed size. A match votes for the diagonal: its place in the document less its place in the template.
2. Votes are aggregated by (document, template, diagonal); diagonals at most SLACK apart are merged into one, so that
   words put in or left out don't part a notice. A phrase needs all its votes on one diagonal.
3. Where the places of a merged diagonal cover SHARE of a notice's words, the span is verified word by word on the
   text, and the notice's label is added. The labels of phrases stay.

The score is 1 where a phrase stands, else the largest share of a notice that votes cover, 0 without any.

Documents meet their votes by a hash of doc_id and text, so rows alike in both share one result and a null doc_id is
no harm. Null and empty texts have no words, no places, no labels and score 0. A text may be of any length; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import words as W

GRAM, SLACK, SHARE = 3, 8, 0.75
#: Grams that a task sends at once.
SEND = 1 << 16


@dataclass(frozen=True)
class Template:
    """`exact`: the words must all stand consecutively."""

    label: str
    text: str
    exact: bool = False


# The phrases and labels of the scan.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Notices as their licenses give them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("boost", "Distributed under the Boost Software License, Version 1.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)
TEMPLATES = PHRASES + NOTICES

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(texts: list[str] | pa.Array) -> W.Words:
    texts = pa.array(texts, pa.large_string()).cast(pa.large_binary()) if isinstance(texts, list | tuple) else texts
    return W.words_of(texts, True, _WORD_BYTE)


def _grams(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all GRAM consecutive words of one text."""
    hashes = W.grams(w.hashes, GRAM)
    here = np.flatnonzero(W.inside(w.first, GRAM, len(hashes)))
    return here, hashes[here]


def _places(templates: tuple[Template, ...]) -> tuple[list[tuple], list[int]]:
    """(gram, template, place) of every template, and how many words each has."""
    w = _words([t.text for t in templates])
    here, hashes = _grams(w)
    of = np.searchsorted(w.first, here, "right") - 1
    rows = [(int(g), int(t), int(p)) for g, t, p in zip(hashes.view("int64"), of, here - w.first[of], strict=True)]
    sizes = np.diff(w.first).tolist()
    if any(n < GRAM for n in sizes):
        raise ValueError(f"a template has fewer than {GRAM} words")
    return rows, sizes


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, place, gram) of all rolling grams."""
    for batch in batches:
        tags = batch.column("tag").to_numpy()
        for row, texts in W.blocks(batch.column("text")):
            w = _words(texts)
            here, hashes = _grams(w)
            doc = np.searchsorted(w.first, here, "right") - 1
            columns = [tags[row + doc], (here - w.first[doc]).astype("int32"), hashes.view("int64")]
            for at in range(0, len(here), SEND):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + SEND]) for c in columns], ["tag", "place", "gram"])


def votes(rows: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """tag, template, from, to (first and last diagonal), covered (words of the template) of merged diagonals."""
    spark = rows.sparkSession
    places, sizes = _places(templates)
    table = spark.createDataFrame(places, "gram long, template int, at int")
    grams = rows.mapInArrow(_rolling, "tag long, place int, gram long")
    # The templates are constants: their table is of a fixed size.
    matched = grams.join(F.broadcast(table), "gram").select("tag", "template", (F.col("place") - F.col("at")).alias("diagonal"), "at")
    exact = F.array(*[F.lit(t.exact) for t in templates])
    size = F.array(*[F.lit(n) for n in sizes])
    order = Window.partitionBy("tag", "template").orderBy("diagonal", "at")
    slack = F.when(F.get(exact, "template"), 0).otherwise(SLACK)
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")
    # Repeated rows vote once.
    merged = matched.distinct().withColumn("_new", F.coalesce(apart, F.lit(1))).withColumn("_chain", F.sum("_new").over(order))
    words = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda p: F.transform(F.sequence(F.lit(0), F.lit(GRAM - 1)), lambda i: p + i))))
    found = merged.groupBy("tag", "template", "_chain").agg(
        F.min("diagonal").alias("from"), F.max("diagonal").alias("to"), F.size(words).alias("covered")
    )
    found = found.withColumns({"size": F.get(size, "template"), "exact": F.get(exact, "template")})
    return found.where(~F.col("exact") | (F.col("covered") == F.col("size"))).drop("_chain")


def _verify(templates: tuple[Template, ...]):
    """n_words of every row, and the labels of the spans whose words are the template's."""
    cut = [_words([t.text]) for t in templates]

    def covered(w: W.Words, first: int, last: int, t: int, span: dict) -> float:
        own = cut[t]
        size = len(own.hashes)
        hit = np.zeros(size, bool)
        for diagonal in range(span["from"], span["to"] + 1):
            low, high = max(0, -diagonal), min(size, last - first - diagonal)
            same = np.zeros(size, bool)
            if high > low:
                begin = first + diagonal
                same[low:high] = w.hashes[begin + low : begin + high] == own.hashes[low:high]
                run = np.convolve(same, np.ones(GRAM, "int64")) >= GRAM  # ends of full runs
                for end in np.flatnonzero(run):
                    a, b = end - GRAM + 1, end + 1
                    if not hit[a:b].all() and w.body(begin + a, begin + b) == own.body(a, b):
                        hit[a:b] = True
        return hit.sum() / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            n_words, labels = np.zeros(batch.num_rows, "int64"), []
            for row, texts in W.blocks(batch.column("text")):
                w = _words(texts)
                n_words[row : row + len(texts)] = np.diff(w.first)
                for k in range(len(texts)):
                    good = [s for s in spans[row + k] or [] if covered(w, w.first[k], w.first[k + 1], s["template"], s) >= SHARE]
                    labels.append(sorted({templates[s["template"]].label for s in good}))
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "spans")]
            names = [c for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words), pa.array(labels, pa.list_(pa.string()))], [*names, "n_words", "verified"])

    return run


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels (sorted arrays), score."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("doc_id", "text"))
    found = votes(rows.select("tag", "text"), templates)
    share = F.col("covered") / F.col("size")
    label = F.get(F.array(*[F.lit(t.label) for t in templates]), "template")
    exact = F.col("exact")
    of_doc = found.groupBy(F.col("tag").alias("_tag")).agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("from"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("from"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(exact, label))).alias("base_labels"),
        F.collect_list(F.when(~exact & (share >= SHARE), F.struct("template", "from", "to"))).alias("spans"),
        F.max(F.when(exact, 1.0).otherwise(share)).alias("score"),
    )
    joined = rows.join(of_doc, F.col("tag") == F.col("_tag"), "left").drop("tag", "_tag")
    key = docs.schema["doc_id"].dataType.simpleString()
    base = "n_base long, first_word long, last_word long, base_labels array<string>, score double"
    columns = joined.select("doc_id", "n_base", "first_word", "last_word", "base_labels", "score", "text", "spans")
    done = columns.mapInArrow(_verify(templates), f"doc_id {key}, {base}, n_words long, verified array<string>")
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base_labels", none)
    return done.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, "verified")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
