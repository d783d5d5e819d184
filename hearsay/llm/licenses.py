"""License scans.  DataFrame operations only.

Base: places where the words of a known phrase stand consecutively.
Method: an exact set-similarity join of word windows with license templates.
A window slides over the whole text, across line breaks, and is a quarter longer
than the template (``reach``).  Tokens are ordered by their frequency over all
documents, rarest first; a window and a template can only reach the containment
threshold if the window holds one of the template's first tokens in that order
(prefix filter), enough tokens at all (length filter) and enough room after the
shared token on both sides (positional filter).  Only windows around a place of
such a first token are formed, and only if the words around it hold enough of the
template.  Pairs that pass are verified by their intersection.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Words of published license notices and the labels they give: the
# short forms that name a license, and sentences of the notices themselves.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program if not see"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)
#: Nearly all of a template: one missing word may be the one that tells two licenses apart.
THRESHOLD = 0.9
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _flat(text: Column) -> Column:
    """The words of a text, each after one space, and a space at the end."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, " ", ""))


def needed(tokens: int, threshold: float) -> int:
    return math.ceil(threshold * tokens - 1e-9)


def reach(words: int) -> int:
    """Words of a window: those of a notice, and a few that stand between them."""
    return words + max(1, words // 4)


def token_order(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> list[str]:
    """The templates' tokens, rarest over all documents first.  As many rows as
    the templates have tokens come to the driver, whatever the input."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    found = docs.select(F.explode(F.array_intersect(F.split(_flat(F.col(text_col)), " "), F.array([F.lit(w) for w in vocabulary]))).alias("w")).groupBy("w").count()
    n = {r["w"]: r["count"] for r in found.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels`` (arrays) and ``score``: 1 if a
    phrase was found, else the best containment of a template found, else 0."""
    order = token_order(docs, text_col, templates)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, t in templates:
        ids = sorted(rank[w] for w in set(t.split()))
        index.append((label, ids, needed(len(ids), threshold), reach(len(t.split()))))
    prefix = sorted({i for _, ids, need, _ in index for i in ids[: len(ids) - need + 1]})
    df = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    df = df.withColumn("__flat", _flat(F.col("__text")))
    df = df.withColumn("n_words", F.when(F.col("__flat") == "  ", F.lit(0)).otherwise(_spaces(F.col("__flat")) - 1).cast("bigint"))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in phrases:
        size = len(phrase.split())
        parts = F.when(F.contains(F.col("__flat"), F.lit(f" {phrase} ")), F.split(F.col("__flat"), f" {phrase}(?= )"))
        name = f"__{label}"
        df = df.withColumn(name, parts)
        counts.append(F.coalesce(F.size(F.col(name)) - 1, F.lit(0)))
        firsts.append(_spaces(F.element_at(F.col(name), 1)))
        lasts.append(F.col("n_words") - _spaces(F.element_at(F.col(name), -1)) + 1 - size)
        labels.append(F.when(F.col(name).isNotNull(), F.lit(label)))
    n_base = sum(counts[1:], counts[0])
    base = F.array_sort(F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull())))
    # places of template tokens in the few documents that hold a prefix token at all
    may = F.arrays_overlap(F.split(F.col("__flat"), " "), F.array([F.lit(order[i]) for i in prefix]))
    places = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    words = F.when(may, F.split(F.trim("__flat"), " ")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__ids", F.transform(words, lambda w: F.coalesce(F.try_element_at(places, w), F.lit(-1))))
    first_tokens = F.array([F.lit(i) for i in prefix])
    anchors = F.filter(F.transform("__ids", lambda x, i: F.struct(x.alias("token"), (i + 1).alias("place"))), lambda a: F.array_contains(first_tokens, a["token"]))
    # a template: its tokens in order, the overlap it needs, its label, the words of its windows
    table = F.array([F.struct(F.lit(label).alias("label"), F.array([F.lit(i) for i in ids]).alias("ids"), F.array([F.lit(i) for i in ids[: len(ids) - need + 1]]).alias("prefix"), F.lit(need).alias("need"), F.lit(size).alias("size")) for label, ids, need, size in index])

    def could(b: Column, t: Column) -> Column:
        long_enough = F.size(b) >= t["need"]
        i = lambda w: F.array_position(t["ids"], w)  # noqa: E731  from 1
        j = lambda w: F.array_position(b, w)
        room = lambda w: F.least(i(w), j(w)) + F.least(F.size(t["ids"]) - i(w), F.size(b) - j(w)) >= t["need"]
        return long_enough & F.arrays_overlap(b, t["prefix"]) & F.exists(t["prefix"], lambda w: (j(w) > 0) & room(w))

    def overlap(b: Column, t: Column) -> Column:
        return F.size(F.array_intersect(b, t["ids"]))

    def start(a: Column, t: Column) -> Column:
        return F.greatest(F.lit(1), a["place"] - t["size"] + 1)

    def near(a: Column, t: Column) -> Column:
        around = F.slice("__ids", start(a, t), a["place"] + t["size"] - start(a, t))
        return F.array_contains(t["prefix"], a["token"]) & (overlap(around, t) >= t["need"])

    def windows(a: Column, t: Column) -> Column:
        return F.transform(F.sequence(start(a, t), a["place"]), lambda i: F.array_sort(F.array_distinct(F.filter(F.slice("__ids", i, t["size"]), lambda x: x >= 0))))

    def scores(a: Column, t: Column) -> Column:
        held = F.filter(windows(a, t), lambda b: could(b, t) & (overlap(b, t) >= t["need"]))
        return F.transform(held, lambda b: F.struct((overlap(b, t) / F.size(t["ids"])).alias("score"), t["label"].alias("label")))

    found = F.flatten(F.transform(anchors, lambda a: F.flatten(F.transform(F.filter(table, lambda t: near(a, t)), lambda t: scores(a, t)))))
    df = df.withColumn("__base", base).withColumn("__found", found).withColumn("__n", n_base.cast("bigint"))
    first = F.least(*firsts, F.lit(None).cast("int")).cast("bigint")
    last = F.greatest(*lasts, F.lit(None).cast("bigint")).cast("bigint")
    return df.select(
        F.col("__id").alias(id_col),
        "n_words",
        F.col("__n").alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        F.col("__base").alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(F.col("__base"), F.transform("__found", lambda x: x["label"])))).alias("labels"),
        F.when(F.col("__n") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("__found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )
