"""License scan by diagonal voting, in Spark's own expressions.

Every run of two and of five words of a text is hashed and joined to the template places that have the same run. A
match votes for its diagonal, the text's place less the template's: words in the same order vote for the same one.
Diagonals of a template that lie side by side (words put in or left out) are merged, and a merged span is verified
by its votes and its length. Phrases must stand word for word, so theirs are single diagonals with all votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgersift.llm.tables import only, stored

# The phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wording of well-known licenses, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
            "by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
SHORT, LONG = 2, 5  # words of a run, for phrases and for license wording
SHIFT = 2  # diagonals this close are one
COVERAGE = 0.6  # share of a license's runs that must be found
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _places(spark: SparkSession, size: int, templates: list[tuple[int, str]]) -> DataFrame:
    """(hash, places): for each run of ``size`` words the templates and places that have it."""
    rows = [(number, at, words[at:at + size])
            for number, text in templates for words in [text.split()] for at in range(len(words) - size + 1)]
    runs = spark.createDataFrame(rows, "template int, at int, run array<string>")
    return (runs.select(F.xxhash64(*[F.get("run", F.lit(k)) for k in range(size)]).alias(f"hash{size}"),
                        F.struct("template", "at", "run").alias("place"))
            .groupBy(f"hash{size}").agg(F.collect_list("place").alias(f"places{size}")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters of the whole text. n_base
    counts all places of the phrases, and first_word and last_word are the least and greatest start (null without).
    Labels are distinct, sorted and comma-joined, empty without. score is the best share of a license's runs that
    was found, 1 for a phrase, 0 without labels. spans lists label, start and end (in words) of all finds. A null
    or empty text has no words. Rows are told apart even when they repeat; a null doc_id stays null.
    """
    spark = docs.sparkSession
    phrases = [(k, text) for k, text in enumerate(PHRASES)]
    licenses = [(len(phrases) + k, text) for k, (_, text) in enumerate(TEMPLATES)]
    names = [*PHRASES.values(), *(label for label, _ in TEMPLATES)]
    info = spark.createDataFrame(
        [(k, names[k], k < len(phrases), len(text.split())) for k, text in phrases + licenses],
        "template int, label string, is_phrase boolean, length int")
    # The templates are constants of this module: their tables are of fixed size and may be broadcast.
    short, long = F.broadcast(_places(spark, SHORT, phrases)), F.broadcast(_places(spark, LONG, licenses))

    worded = only(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), F.lit(_WORD),
                             F.lit(0)).alias("words"))
    run = [F.get("words", F.col("i") + k) for k in range(LONG)]
    n = F.size("words")
    # A row for each word, and one for a text without any; row 0 stands for the text itself.
    each = worded.select("row", "doc_id", "words", n.cast("long").alias("n_words"),
                         F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("i"))
    hashed = each.select("row", "doc_id", "n_words", "i", F.array(*run).alias("run"),
                         F.when(F.col("i") + SHORT <= n, F.xxhash64(*run[:SHORT])).alias(f"hash{SHORT}"),
                         F.when(F.col("i") + LONG <= n, F.xxhash64(*run)).alias(f"hash{LONG}"))
    none = F.array().cast("array<struct<template: int, at: int, run: array<string>>>")
    met = (hashed.join(short, f"hash{SHORT}", "left").join(long, f"hash{LONG}", "left")
           .where(F.col(f"places{SHORT}").isNotNull() | F.col(f"places{LONG}").isNotNull() | (F.col("i") == 0))
           .select("row", "doc_id", "n_words", "i", "run",
                   F.concat(F.coalesce(f"places{SHORT}", none), F.coalesce(f"places{LONG}", none)).alias("places")))
    hits = stored(met, "license-hits")

    votes = (hits.select("row", "i", "run", F.explode("places").alias("place"))
             .where(F.slice("run", 1, F.size("place.run")) == F.col("place.run"))  # the words themselves agree
             .select("row", F.col("place.template").alias("template"), F.col("place.at").alias("at"),
                     (F.col("i") - F.col("place.at")).alias("diagonal"))
             .groupBy("row", "template", "diagonal")
             .agg(F.count_distinct("at").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
             .join(F.broadcast(info), "template"))
    order = W.partitionBy("row", "template").orderBy("diagonal")
    phrase_spans = (votes.where("is_phrase AND votes = length - 1")
                    .select("row", "template", "label", "is_phrase", F.col("diagonal").alias("start"),
                            (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("share")))
    license_spans = (
        votes.where("NOT is_phrase")
        .withColumn("new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(order), F.col("diagonal"))
                            > SHIFT).cast("int"))
        .withColumn("group", F.sum("new").over(order))
        .groupBy("row", "template", "label", "is_phrase", "length", "group")
        .agg(F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("start"),
             F.max(F.col("diagonal") + F.col("high") + LONG).alias("end"))
        .withColumn("share", F.least(F.col("votes") / (F.col("length") - LONG + 1), F.lit(1.0)))
        .where((F.col("share") >= COVERAGE) & (F.col("end") - F.col("start") <= 1.5 * F.col("length") + SHIFT))
        .select("row", "template", "label", "is_phrase", "start", "end", "share"))
    found = (phrase_spans.unionByName(license_spans).groupBy("row").agg(
        F.count_if("is_phrase").alias("n_base"),
        F.min(F.when(F.col("is_phrase"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_phrase"), F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("is_phrase"), F.col("label")))).alias("base"),
        F.array_sort(F.collect_set("label")).alias("every"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans")))
    return (hits.where("i = 0").select("row", "doc_id", "n_words").join(found, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word",
                    "last_word", F.coalesce(F.concat_ws(",", "base"), F.lit("")).alias("base_labels"),
                    F.coalesce(F.concat_ws(",", "every"), F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score"), "spans"))
