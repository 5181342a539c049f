"""License scan by diagonal voting, in DataFrame operations only.

Phrases and license notices are templates.  All rolling word k-gram hashes of a
document (k = 2 for phrases, 4 for notices) are joined to the positions where a
template has that gram, and the words of a hit are compared, so hashes only
find candidates.  A hit votes for its diagonal: place in the document less place
in the template.

* A phrase stands where its diagonal has a vote for each of its grams.
* Votes for a notice on diagonals at most ``GAP`` apart are merged, since a
  changed notice shifts; the merged span is a finding if its hits cover at least
  ``min_cover`` of the notice's words, within twice its length.

The templates are a fixed list of a few thousand grams at most (checked), and
are broadcast.

Words are runs of letters, digits and non-ASCII, A-Z lower-cased.  Null and
empty texts have no words: counts 0, places null, labels empty, score 0.
Repeated rows give repeated results, null ids stay null, other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contigloom.llm.shared import ascii_lower

_OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 3
MOST_GRAMS = 100_000

# Phrases that the scan counts, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License notices in their published wording, and their labels.
NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at": "apache",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "Licensed under CC BY 4.0.": "cc-by",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
}


def _words(text):
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _OUTSIDE), lambda w: w != "")


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(template, label, phrase, size, k) with the words of each."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases.items(), *notices.items()])]
    listed = spark.createDataFrame(rows, "template int, text string, label string, phrase boolean")
    listed = listed.select("template", "label", "phrase", _words(F.col("text")).alias("words"))
    return listed.withColumn("size", F.size("words")).withColumn("k", F.when(F.col("phrase"), 2).otherwise(4)).where("size >= k")


def _grams(words, k: int):
    """Hash of the words i .. i + k - 1 for every i."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>")
    )


def hits(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, text_key, template, at, place): equal grams of documents and templates, copies of a row counted once."""
    index = listed.select(
        "template", "k", F.posexplode_outer(F.when(F.col("k") == 2, _grams(F.col("words"), 2)).otherwise(_grams(F.col("words"), 4))).alias("place", "gram"), "words"
    ).select("template", "k", "place", "gram", F.array_join(F.slice("words", F.col("place") + 1, F.col("k")), " ").alias("gram_text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), _words(F.col("text")).alias("words"))
    grams = texts.withColumn("grams", F.concat(_grams(F.col("words"), 2), _grams(F.col("words"), 4)))
    # outer: else a filter on the grams' size is inferred and pushed below, where it would split every text once for each gram
    rows = grams.select("doc_id", "text_key", "words", F.posexplode_outer("grams").alias("nth", "gram"))
    pairs_of = F.greatest(F.size("words") - 1, F.lit(0))  # how many of the grams are of two words
    short = F.col("nth") < pairs_of
    at = F.when(short, F.col("nth")).otherwise(F.col("nth") - pairs_of)
    return (
        rows.join(F.broadcast(index), "gram")
        .where((short == (F.col("k") == 2)) & (F.array_join(F.slice("words", at + 1, F.col("k")), " ") == F.col("gram_text")))
        .select("doc_id", "text_key", "template", at.alias("at"), "place")
        .distinct()
    )


def spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, min_cover: float = 0.75) -> DataFrame:
    """(doc_id, text_key, template, label, phrase, start, end, cover): findings, words from 0, end exclusive."""
    listed = templates(docs.sparkSession, phrases, notices)
    grams = sum(len(t.split()) for t in [*phrases, *notices])
    if grams > MOST_GRAMS:
        raise ValueError(f"templates of {grams} words are too many to broadcast")
    document = ["doc_id", "text_key", "template"]
    known = F.broadcast(listed.select("template", "label", "phrase", "size", "k"))
    voted = hits(docs, listed).withColumn("diagonal", F.col("at") - F.col("place")).join(known, "template")
    along = Window.partitionBy(*document).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    bundled = voted.withColumn("opens", apart.cast("int")).withColumn("bundle", F.sum("opens").over(along))
    # a phrase has each diagonal for itself, a notice the neighbouring ones together
    span = [*document, "label", "phrase", "size", "k", "unit"]
    units = bundled.withColumn("unit", F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.col("bundle")))
    covered = (
        units.select(*span, "at", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("k") - 1)).alias("word"))
        .groupBy(*span, "word")
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
        .groupBy(*span)
        .agg(F.count("*").alias("words"), F.min("lo").alias("lo"), (F.max("hi") + F.first("k")).alias("end"))
    )
    whole = F.col("words") == F.col("size")
    enough = (F.col("words") >= min_cover * F.col("size")) & (F.col("end") - F.col("lo") <= 2 * F.col("size"))
    return covered.where(F.when(F.col("phrase"), whole).otherwise(enough)).select(
        *document, "label", "phrase", F.col("lo").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("words") / F.col("size")).alias("cover")
    )


def scan(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; score is the best cover."""
    base = F.col("phrase")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = (
        spans(docs, **parameters)
        .groupBy("doc_id", "text_key")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),  # of a fixed list
            joined(F.collect_set("label")).alias("labels"),
            F.max("cover").alias("score"),
        )
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.size(_words(F.col("text"))).cast("long").alias("n_words")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
