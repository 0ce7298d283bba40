"""License scans: exact set-similarity join of text blocks with license templates.

A template is a license notice of m words; a block is any run of m consecutive
words of a text, over line and paragraph breaks. Both become sets of
lower-cased words, and a block meets the template when it holds at least
``CONTAINMENT`` of the template's words. Tokens are ordered by how often they
occur in the whole corpus, rarest first (only tokens of templates matter). A
template of s distinct words needs ``t = ceil(CONTAINMENT s)`` matches, so a
matching block holds one of the template's s - t + 1 rarest tokens (prefix
filter): only the runs around such a token are looked at. The words less than
m places from it must hold t distinct ones of the template (length filter),
and a run counts only from the token's place back to m - 1 words before it
(positional filter); of a run, the words from its first template word on
decide. What passes is verified by exact counts of distinct words.

Beside the sets, base phrases are found where their words stand
consecutively, anywhere in the text. All of it is DataFrame expressions; a
text's words near a rare token are at most 2 m, so no array grows with the
text but its own words.

Defined results: a null text counts as empty; without a phrase first_word and
last_word are null; without a label the label strings are empty; repeated
rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8

#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notice -> label. Notices that licenses ask to be placed in files.
TEMPLATES = {
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that are no part of a word, without the line feed.
_OTHER = "".join(map(chr, [*range(0, 10), *range(11, 48), *range(58, 65), *range(91, 97), *range(123, 128)]))


def normal(text: Column) -> Column:
    """A-Z lower-cased, everything between words a blank, line feeds kept."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))


def tokens_of(text: str) -> list[str]:
    """The words of a short text, by the rule of :func:`normal`."""
    lower = text.translate({ord(u): ord(u) + 32 for u in _UPPER})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(flat: Column, phrase: str, n_words: Column) -> dict[str, Column]:
    """Number, first and last word index of the places of ``phrase`` in
    ``flat`` (words with one blank before each, and one at the end)."""
    w = tokens_of(phrase)
    if not w or any(w[k:] == w[:-k] for k in range(1, len(w))):
        raise ValueError(f"a phrase needs words and must not overlap itself: {phrase!r}")
    there = flat.contains(" " + " ".join(w) + " ")
    # cut before each place: the words of the first part stand before the first place, and so on
    parts = F.split(flat, " " + " ".join(map(re.escape, w)) + "(?= )")
    return {"n": F.when(there, F.size(parts) - 1).otherwise(0).cast("long"),
            "first": F.when(there, _blanks(F.element_at(parts, 1))).cast("long"),
            "last": F.when(there, n_words - (_blanks(F.element_at(parts, -1)) - 1) - len(w)).cast("long")}


def _frequencies(norm: DataFrame, known: list[str]) -> dict[str, int]:
    """How often each template token occurs in the whole corpus (one row per token)."""
    return {r.w: r.n for r in norm.select(F.explode(F.split("norm", "[ \n]+")).alias("w")).where(F.col("w").isin(known))
            .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
         containment: float = CONTAINMENT) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels and
    labels (sorted arrays) and score: the highest containment of a template
    met; without one 0.5 where a base phrase stands, else 0."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    sets = [(label, len(w), sorted(set(w))) for t, label in templates.items() if (w := tokens_of(t))]
    known = sorted({w for _, _, t in sets for w in t})
    longest = max((m for _, m, _ in sets), default=0)
    norm = docs.select("doc_id", normal(F.col("text")).alias("norm"))

    # global order, rarest first; then per template its tokens as ranks
    count = _frequencies(norm, known) if known else {}
    rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (count.get(w, 0), w)))}
    index = []
    for label, m, t in sets:
        ranks = sorted(rank[w] for w in t)
        need = math.ceil(containment * len(t) - 1e-9)
        for r in ranks[:len(t) - need + 1]:                # prefix filter
            index.append((r, label, m, len(t), need, ranks))
    index_table = spark.createDataFrame(index, "r int, label string, m int, size int, need int, ranks array<int>")
    first_tokens = sorted({w for w in known if rank[w] in {x[0] for x in index}})

    # base phrases
    n_words = F.when(F.col("one") == " ", F.lit(0)).otherwise(_blanks(F.col("one")) - 1).cast("long")
    rows = (norm.withColumn("one", F.concat(F.lit(" "), F.trim(F.regexp_replace("norm", "[ \n]+", " ")), F.lit(" ")))
            .withColumn("one", F.when(F.col("one") == "  ", " ").otherwise(F.col("one")))
            .withColumn("n_words", n_words))
    places = [(label, _places(F.col("one"), p, F.col("n_words"))) for p, label in phrases.items()]
    none = F.lit(None).cast("long")
    base = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(p["n"] > 0, F.lit(label)) for label, p in places], F.lit(None).cast("string")),
        lambda x: x.isNotNull())))
    if first_tokens:
        # places of template words in the texts that hold a rare token, and around each rare one its neighbours
        order = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
        found = " (?:" + "|".join(map(re.escape, first_tokens)) + ") "
        words = F.when(F.col("one").rlike(found), F.split(F.trim("one"), " "))
        rows = rows.withColumn("hits", F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.try_element_at(order, w).alias("r"))),
                                                lambda h: h["r"].isNotNull()))
        rare = [F.lit(rank[w]) for w in first_tokens]
        near = F.transform("hits", lambda h, i: F.when(h["r"].isin(*rare), F.struct(
            h["at"].alias("at"), h["r"].alias("r"),
            F.slice("hits", F.greatest(i - longest + 2, F.lit(1)), F.lit(2 * longest)).alias("near"))))
        anchors = F.filter(near, lambda x: x.isNotNull())
    else:
        anchors = F.lit(None).cast("array<struct<at: int, r: int, near: array<struct<at: int, r: int>>>>")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words",
        sum((p["n"] for _, p in places), F.lit(0).cast("long")).alias("n_base"),
        F.least(none, none, *[p["first"] for _, p in places]).alias("first_word"),
        F.greatest(none, none, *[p["last"] for _, p in places]).alias("last_word"),
        base.alias("base"), anchors.alias("anchors"))

    one = rows.withColumn("anchor", F.explode_outer("anchors")).drop("anchors").select("*", "anchor.*").drop("anchor")
    t = F.broadcast(index_table)                           # a row per token of a template's prefix
    met = one.join(t, one["r"] == t["r"], "left")
    # template words in runs around the rare token
    met = met.withColumn("near", F.filter("near", lambda h: (h["at"] > F.col("at") - F.col("m")) & (h["at"] < F.col("at") + F.col("m"))
                                          & F.array_contains("ranks", h["r"])))
    enough = F.size(F.array_distinct(F.transform("near", lambda h: h["r"]))) >= F.col("need")

    def held(start: Column) -> Column:
        """Distinct template words in the run of m words from ``start``."""
        return F.size(F.array_distinct(F.transform(F.filter("near", lambda h: (h["at"] >= start) & (h["at"] < start + F.col("m"))), lambda h: h["r"])))

    overlap = F.when(F.col("label").isNotNull() & enough,
                     F.array_max(F.transform(F.filter("near", lambda h: h["at"] <= F.col("at")), lambda h: held(h["at"]))))
    met = met.withColumn("overlap", overlap)
    ok, overlap = F.col("overlap") >= F.col("need"), F.col("overlap")
    out = (met.groupBy("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base")
           .agg(F.collect_set(F.when(ok, F.col("label"))).alias("more"), F.max(F.when(ok, overlap / F.col("size"))).alias("best")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"),
                      F.array_sort(F.array_union("base", "more")).alias("labels"),
                      F.coalesce("best", F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"))
