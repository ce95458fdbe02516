"""License notices found by diagonal voting, in DataFrame functions only.

Every run of three words of a text is joined by its hash to the places where
license templates have it (and its words are compared).  A match votes for
the diagonal ``place in the text - place in the template``.  Diagonals of a
template that lie close together, as where words were put in or left out, are
merged; the merged span is accepted if enough of the template's words are
covered and the span is not much longer than the template.  Of accepted spans
that overlap, those that cover most of their template stay.

The templates are a fixed list, so the side that is broadcast has a few hundred
rows whatever the input; a license in very many documents makes groups by
document, never one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.functions.text import let

GRAM = 3
# Diagonals at most so far apart are one span.
SLACK = 4
# Share of a template's words that a span has to cover, and its longest length
# against the template.
COVERED, LONGEST = 0.75, 1.5

# Public license notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
]
# Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))


def words_of(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def grams(line: Column) -> Column:
    """All runs of ``GRAM`` words, as text, in order; null where the text ends."""
    def runs(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.concat(w, *[x for k in range(1, GRAM) for x in (F.lit(" "), F.get(words, i + k))]))

    return let(words_of(line), runs)


def _phrase_places(line: Column) -> Column:
    """``label, place`` of every phrase; only texts that can have one are looked through."""
    def found(words: Column) -> Column:
        def here(w: Column, i: Column) -> Column:
            label = F.lit(None).cast("string")
            for phrase, name in PHRASES:
                first, *rest = phrase.split(" ")
                same = w == first
                for k, word in enumerate(rest, 1):
                    same &= F.coalesce(F.get(words, i + k) == word, F.lit(False))
                label = F.when(same, name).otherwise(label)
            return F.struct(label.alias("label"), i.cast("long").alias("place"))

        return F.filter(F.transform(words, here), lambda x: x["label"].isNotNull())

    likely = F.lit(False)
    for phrase, _ in PHRASES:
        likely |= line.contains(phrase)
    return F.when(likely, let(words_of(line), found)).otherwise(F.array().cast("array<struct<label:string,place:bigint>>"))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``gram, gram_hash, template, label, size, at`` of all templates."""
    rows = [(number, label, text) for number, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, body string").select("template", "label", spaced(F.col("body")).alias("line"))
    sized = table.select("template", "label", F.size(words_of(F.col("line"))).cast("long").alias("size"), F.posexplode(grams(F.col("line"))).alias("at", "gram"))
    return sized.filter("gram IS NOT NULL").select("template", "label", "size", F.col("at").cast("long").alias("at"), "gram", F.xxhash64("gram").alias("gram_hash"))


def spans(documents: DataFrame, key: list[str], line: str, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """License spans of the spaced texts in column ``line``.

    Returns the key columns, ``template, label, first, last`` (words, from 0,
    last included), ``covered`` (template words) and ``share`` of the template.
    Rows with one key are one text.
    """
    runs = documents.select(*key, F.posexplode(grams(F.col(line))).alias("place", "gram")).filter("gram IS NOT NULL")
    runs = runs.withColumn("gram_hash", F.xxhash64("gram"))
    known = F.broadcast(template_grams(documents.sparkSession, templates)).alias("t")
    runs = runs.alias("r")
    votes = runs.join(known, (F.col("r.gram_hash") == F.col("t.gram_hash")) & (F.col("r.gram") == F.col("t.gram"))).select(
        *[F.col(f"r.{k}") for k in key], "t.template", "t.label", "t.size", "t.at", (F.col("r.place") - F.col("t.at")).alias("diagonal"))
    diagonals = votes.groupBy(*key, "template", "label", "size", "diagonal").agg(F.collect_set("at").alias("places"))
    near = Window.partitionBy(*key, "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SLACK, F.lit(True))
    merged = diagonals.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(near))
    first = F.col("diagonal") + F.array_min("places")
    last = F.col("diagonal") + F.array_max("places") + GRAM - 1
    one = merged.groupBy(*key, "template", "label", "size", "span").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.min(first).alias("first"), F.max(last).alias("last"))
    covered = F.aggregate(
        F.transform("places", lambda at, i: F.least(F.lit(GRAM).cast("long"), F.coalesce(F.get("places", i + 1) - at, F.lit(GRAM).cast("long")))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    one = one.withColumn("covered", covered).withColumn("share", F.col("covered") / F.col("size"))
    accepted = (F.col("share") >= COVERED) & (F.col("last") - F.col("first") + 1 <= LONGEST * F.col("size") + SLACK)
    # Notices resemble each other: of spans that overlap, those with the best share.
    in_order = Window.partitionBy(*key).orderBy("first", "last", "template")
    reached = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") > reached, F.lit(True)).cast("int")
    regions = one.filter(accepted).withColumn("apart", apart).withColumn("region", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(*key, "region").orderBy(F.desc("share"), F.desc("covered"))
    return regions.withColumn("rank", F.rank().over(best)).filter("rank = 1").select(*key, "template", "label", "first", "last", "covered", "share")


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """License phrases and notices of every row of ``documents`` (doc_id, text;
    more columns are ignored).

    Returns ``doc_id, n_words, places`` (label and first word of every phrase),
    and ``notices``: label, first and last word, and share of the template, of
    every accepted span.  A null text is empty; an empty text has no words.
    Rows of one id and text have the same result, rows of one id and different
    texts their own.  A very long text is one row.  An empty table gives none.
    """
    docs = documents.select("doc_id", spaced(F.col("text")).alias("line"))
    key = ["doc_id", "digest"]
    docs = docs.withColumn("digest", F.unhex(F.md5(F.col("line").cast("binary"))))
    found = spans(docs, key, "line", templates).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "share"))).alias("notices")).alias("f")
    rows = docs.select(
        "doc_id", "digest", F.size(words_of(F.col("line"))).cast("long").alias("n_words"), _phrase_places(F.col("line")).alias("places")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint,label:string,share:double>>")
    return rows.join(found, same, "left").select("d.doc_id", "d.n_words", "d.places", F.coalesce("f.notices", empty).alias("notices"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and labels of ``scan``."""
    starts = F.transform("places", lambda p: p["place"])
    base, own = F.transform("places", lambda p: p["label"]), F.transform("notices", lambda n: n["label"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0)).alias("score"))
