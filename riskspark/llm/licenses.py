"""License scans by diagonal voting, with DataFrame operations only.

All word pairs of every text are hashed and joined with the word pairs of
the license templates.  A hit votes for the diagonal (its place in the text
minus its place in the template); votes are combined per diagonal before
anything is shuffled, diagonals at most ``MERGE`` apart are merged, and a
span counts when enough of the template's pairs were hit; hits further apart
never add up.  A short phrase needs all of
them on one diagonal, that is, its words standing consecutively.

Defined cases: null and empty texts have no words, no place and score 0;
rows with equal id and text get equal results (votes are sets, so repeats
do not add up); null ids are kept; texts of fewer than two words match
nothing; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # what stands between words, capitals lowered

# Phrases and their labels; all words must stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of well-known license notices; a part of them is enough.
NOTICES = (
    ("released under the mit license", "notice-mit"),
    ("licensed under the apache license version 2 0", "notice-apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "notice-gpl-3.0"),
    ("licensed under cc by nc 4 0", "notice-cc-by-nc-4.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "notice-mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0", "notice-apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "notice-gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "notice-bsd"),
    ("this work is licensed under a creative commons attribution", "notice-cc"),
)
ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"    # GAP before capitals are lowered: as many words
MAX_PAIRS = 62          # votes of a template fit the bits of a long
SHARE = 0.6             # part of a notice's pairs that must be hit
MERGE = 4               # a span's diagonals lie at most this far apart: words put in or left out


def words(text: Column) -> Column:
    """The words; only the first and the last piece between gaps can be empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), ANY_CASE_GAP), "")).cast("long")


def _templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, pairs, at, pair): one row per word pair; a fixed, small table."""
    rows = []
    for base, group in ((True, PHRASES), (False, NOTICES)):
        for text, label in group:
            w = text.split()
            if len(w) - 1 > MAX_PAIRS:
                raise ValueError(f"template too long: {text}")
            rows += [(text, label, base, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    t = spark.createDataFrame(rows, "template string, label string, base boolean, pairs int, at int, a string, b string")
    return t.select("template", "label", "base", "pairs", "at", F.xxhash64("a", "b").alias("pair"),
                    F.col("a").alias("first"), F.col("b").alias("second"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                       words(F.col(text)).alias("w"))
    pairs = rows.where(F.size("w") > 1).select(
        "doc_id", "text_hash", F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))
    grams = (pairs.select("doc_id", "text_hash", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "g"))
             .select("doc_id", "text_hash", "pos", "g.a", "g.b", F.xxhash64("g.a", "g.b").alias("pair")))
    hits = (grams.join(F.broadcast(_templates(spark)), "pair")     # a fixed table of some 150 rows
            .where((F.col("a") == F.col("first")) & (F.col("b") == F.col("second")))
            .withColumn("diagonal", F.col("pos") - F.col("at")))
    key = ["doc_id", "text_hash", "template", "label", "base", "pairs"]
    votes = hits.groupBy(*key, "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"))
    # a notice's diagonals from one to MERGE further on make one span; a phrase's stay apart
    near = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, MERGE)
    seen = F.when(F.col("base"), F.col("seen")).otherwise(F.bit_or("seen").over(near))
    spans = (votes.withColumn("merged", seen).withColumn("part", F.bit_count("merged") / F.col("pairs"))
             .withColumnRenamed("diagonal", "start"))
    whole = F.col("base") & (F.col("part") == 1.0)
    named = whole | (~F.col("base") & (F.col("part") >= SHARE))

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("start"))).alias("first_word"),
        F.max(F.when(whole, F.col("start"))).alias("last_word"),
        listed(F.collect_set(F.when(whole, F.col("label")))).alias("base_labels"),
        listed(F.collect_set(F.when(named, F.col("label")))).alias("labels"), F.max("part").alias("score"))
    found = found.withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    all_rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                           count(F.col(text)).alias("n_words"))
    return (all_rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")),
                          "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
                    F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
