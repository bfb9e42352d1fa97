"""License scans by diagonal voting (DataFrame functions only).

Texts become words. Every rolling word k-gram is hashed and joined with the positions of the same hash in the
templates, a fixed table that is broadcast. A match at word i of the text and position j of a template votes for the
diagonal i - j. Votes are added up by diagonal; diagonals close to each other (words were inserted or dropped) merge
into one span; a span counts if enough of the template's positions are found in it, in no more words than the
template could take. Phrases are templates too: of them every k-gram must vote for the same diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Words per k-gram of phrases and of notices, and the word separators: all of ASCII but digits and letters.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this close merge; share of a notice's k-grams that must be found; words a span may have per notice word.
NEAR, LEAST_SHARE, MOST_STRETCH = 8, 0.5, 1.5

# Phrases whose every occurrence counts, and the label of each.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening or central sentences of public license notices.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def words(text: Column) -> Column:
    """The words of a text; beyond ASCII every character is part of a word, so ``lower`` moves no word's bounds and
    changes none of the letters that phrases are made of."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def grams(of: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, the number of words among the hashed values."""
    at = F.sequence(F.lit(0), F.size(of) - k)
    hashed = F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(of, i + j) for j in range(k)]))
    return F.when(F.size(of) >= k, hashed).otherwise(F.array().cast("array<long>"))


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """gram, template, label, phrase (boolean), position, n_grams, n_words: one row per k-gram of a template."""
    rows = [(i, text, label, True) for i, (text, label) in enumerate(phrases.items())]
    rows += [(len(rows) + i, text, label, False) for i, (label, text) in enumerate(notices.items())]
    out = spark.createDataFrame(rows, "template int, text string, label string, phrase boolean").withColumn("_w", words(F.col("text")))
    out = out.withColumn("_g", F.when(F.col("phrase"), grams(F.col("_w"), PHRASE_GRAM)).otherwise(grams(F.col("_w"), NOTICE_GRAM)))
    return out.select("template", "label", "phrase", F.size("_g").alias("n_grams"), F.size("_w").alias("n_words"), F.posexplode_outer("_g").alias("position", "gram"))


def license_spans(docs: DataFrame, key: list[str], phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """For each row of ``docs`` (text and ``key`` columns): n_text_words and ``spans``, an array of (label, phrase,
    start, end, share), words from 0, end exclusive.

    Null texts count as empty. Rows equal in ``key`` and text come back as one; keep a key that tells rows apart, or
    join the result by key and text. No two texts are compared, so groups of copies cost no more than other texts.
    """
    spark = docs.sparkSession
    rule = F.broadcast(templates(spark, phrases, notices))
    own = docs.select(*key, F.xxhash64(text_or_empty()).alias("_text"), words(text_or_empty()).alias("_w"))
    found = own.select(*key, "_text", F.size("_w").alias("n_text_words"), F.concat(F.array(F.lit(None).cast("long")), grams(F.col("_w"), PHRASE_GRAM), grams(F.col("_w"), NOTICE_GRAM)).alias("_g"))
    # outer: else Spark would first filter by the array's size and build it twice
    every = found.select(*key, "_text", "n_text_words", F.posexplode_outer("_g").alias("_at", "gram"))
    # entry 0 carries the row itself; then the 2-grams, of which there is one less than words, then the longer ones
    first = F.when(F.col("_at") < 1 + F.greatest(F.col("n_text_words") - PHRASE_GRAM + 1, F.lit(0)), F.col("_at") - 1).otherwise(
        F.col("_at") - 1 - F.greatest(F.col("n_text_words") - PHRASE_GRAM + 1, F.lit(0))
    )
    row = [*key, "_text", "n_text_words"]
    voted = every.join(rule, "gram", "left").where("_at = 0 OR template IS NOT NULL").select(
        *row, "template", "label", "phrase", "position", "n_grams", "n_words", F.when(F.col("_at") > 0, first).alias("_i")
    )
    template = ["template", "label", "phrase", "n_grams", "n_words"]
    diagonals = voted.groupBy(*row, *template, (F.col("_i") - F.col("position")).alias("_d")).agg(F.collect_set("position").alias("_p"))
    ordered = Window.partitionBy(*row, "template").orderBy("_d")
    new = F.coalesce(F.col("phrase") | (F.col("_d") - F.lag("_d").over(ordered) > NEAR), F.lit(True))
    merged = (
        diagonals.withColumn("_new", new.cast("int"))
        .withColumn("_span", F.sum("_new").over(ordered))
        .groupBy(*row, *template, "_span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("_p"))).alias("_p"),
            F.min(F.col("_d") + F.array_min("_p")).alias("start"),
            F.max(F.col("_d") + F.array_max("_p")).alias("_last"),
        )
    )
    share = F.size("_p") / F.col("n_grams")
    end = F.col("_last") + F.when(F.col("phrase"), PHRASE_GRAM).otherwise(NOTICE_GRAM)
    good = F.when(F.col("phrase"), share == 1.0).otherwise((share >= LEAST_SHARE) & (end - F.col("start") <= MOST_STRETCH * F.col("n_words") + NEAR))
    span = F.struct("label", "phrase", "start", end.alias("end"), share.alias("share"))
    return merged.groupBy(*row).agg(F.array_sort(F.collect_list(F.when(good, span))).alias("spans")).drop("_text")


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of all phrases), first_word and last_word (their smallest and
    largest start, null without any), base_labels and labels (of phrases; of phrases and notices; distinct, sorted,
    comma-joined) and score (1 with a phrase, else the largest share of a notice found, 0 without any).

    Rows are kept one for one, repeated ones too, whatever doc_id holds.
    """
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("_row"), "doc_id").alias("_key"), "text")
    found = license_spans(rows, ["_key"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return found.select(
        "_key.doc_id",
        F.col("n_text_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda s: s["label"])).alias("base_labels"),
        joined(F.transform("spans", lambda s: s["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
