"""License scans by diagonal voting.

Every pair of neighbouring words of every text is joined by its hash to the places that the pair has in the license
templates.  A match votes for a diagonal, the text position less the template position; votes are counted by
text, template and diagonal, neighbouring diagonals (a few words more or less) are merged, and a span is
verified by the share of the template's pairs that voted.  The pairs' words are compared in the join too, so that no
vote rests on a hash alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import text_key, whole_text
from strandline.plans.staging import stage

# Words: runs of ASCII letters, digits and anything beyond ASCII.  Capitals count as their small letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that are labelled wherever their words stand together.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# License notices, label and text.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-any", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]
# Words so common that a pair of them does not vote.
COMMON = ["a", "and", "at", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you"]
DRIFT = 2
SHARE = 0.75
SHORT = 12


def small(c: Column) -> Column:
    return F.translate(c, CAPITALS, SMALL)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_pairs(spark, phrases: Sequence = tuple(PHRASES), notices: Sequence = tuple(NOTICES)) -> DataFrame:
    """(template, base, label, at, pair, pairs): the voting pairs of every template, with their number."""
    rows = [(i, True, label, text) for i, (text, label) in enumerate(phrases)]
    rows += [(len(rows) + i, False, label, text) for i, (label, text) in enumerate(notices)]
    t = spark.createDataFrame(rows, "template int, base boolean, label string, text string")
    t = t.withColumn("w", words(small(F.col("text"))))
    t = t.select("template", "base", "label", F.posexplode(F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))).alias("at", "pair"))
    both_common = F.forall(F.split("pair", " "), lambda w: w.isin(COMMON))
    t = t.filter(F.col("pair").isNotNull() & (F.col("base") | ~both_common))
    return t.withColumn("pairs", F.count(F.lit(1)).over(Window.partitionBy("template"))).withColumn("h", F.xxhash64("pair"))


def spans(docs: DataFrame, pairs: DataFrame, text: str = "text", drift: int = DRIFT, share: float = SHARE) -> DataFrame:
    """(tkey, template, base, label, first, score): verified spans by text key, `first` the word they start at."""
    w = words(whole_text(text))
    body = docs.select(text_key(text).alias("tkey"), w.alias("w"))
    rolling = body.select("tkey", F.posexplode(F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pos", "seen"))
    rolling = rolling.withColumn("h", F.xxhash64(F.lower("seen")))
    # the templates are fixed values, so their size is known
    votes = rolling.join(F.broadcast(pairs), "h").filter(small(F.col("seen")) == F.col("pair"))
    # copies of a text give the same votes: each place counts once
    votes = votes.select("tkey", "template", "base", "label", "pairs", "pos", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    keys = ["tkey", "template", "base", "label", "pairs"]
    lines = votes.groupBy(*keys, "diagonal").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.filter(F.when(F.col("base"), F.col("n") == F.col("pairs")).otherwise(F.col("n") >= F.least(F.lit(2), F.col("pairs"))))
    order = Window.partitionBy("tkey", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    merged = lines.withColumn("island", F.sum(apart.cast("int")).over(order)).groupBy(*keys, "island").agg(F.min("diagonal").alias("first"), F.sum("n").alias("n"))
    score = F.least(F.lit(1.0), F.col("n") / F.col("pairs"))
    needed = F.when(F.col("pairs") < SHORT, 1.0).otherwise(share)  # a short notice leaves no room: one word is its version
    return merged.withColumn("score", score).filter(F.col("score") >= needed).select("tkey", "template", "base", "label", "first", "score")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence = tuple(PHRASES), notices: Sequence = tuple(NOTICES), drift: int = DRIFT, share: float = SHARE) -> DataFrame:
    """Per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are where all words of a phrase stand together; labels of the notices need `share` of the notice's
    pairs (all of fewer than SHORT) on diagonals that are at most `drift` words apart.  Null and empty texts have no words, null places and empty labels;
    repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    found = spans(docs, template_pairs(docs.sparkSession, phrases, notices), text, drift, share)
    base = F.when(F.col("base"), F.col("first"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    verdict = stage(
        found.groupBy("tkey").agg(
            F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score"),
        )
    )
    slim = docs.select(key, text_key(text).alias("tkey"), F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("n_words"))
    out = slim.join(verdict, "tkey", "left")
    return out.select(
        key, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
