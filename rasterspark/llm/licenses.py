"""License scan by diagonal voting, in DataFrame functions only.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered. Every rolling pair
of words is hashed and joined to the pairs of the templates; a hit at word i of a document and
word t of a template votes for the diagonal i - t. Votes are gathered for each diagonal as a set of
template places (bits of a long), diagonals no more than `slack` apart are merged (they come from
inserted or dropped words), and a merged span is verified by the share of the template's pairs that it
holds, each counted once. A diagonal that begins past the words of the one before it is the next copy
and not merged; where diagonals still merge to more than twice the template's length, each is judged
on its own.

Documents are read and split once. Pairs that no template has are left out before the rows are made,
and the templates are a small fixed table (below), so the join is a broadcast of known size; a pair's
text is compared beside its hash, so a collision can't count. Hits, and one row for each document
without any, are shuffled once, by a number of their row.

Null and empty texts have no words and no labels. Rows that repeat a doc_id, or are identical, are
each scanned. An empty table gives an empty one; a long text is a row like any other. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The phrases and labels of the base count.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Well-known sentences of public licences, with the labels the method adds.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0-text", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0-text", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("spdx", "spdx license identifier"),
    ("rights-reserved", "all rights reserved"),
]

#: Places of a template whose votes are the bits of one long.
PART = 63

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def template_table(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each pair of words of each template. part, place: the number of the pair, as a group of PART and a bit in it."""
    rows = []
    for number, (text, label, base) in enumerate([(t, x, True) for t, x in phrases] + [(t, x, False) for x, t in templates]):
        w = text.split()
        if len(w) < 2:
            raise ValueError(f"a template has 2 words or more: {text}")
        rows += [(number, label, base, t, t // PART, 1 << t % PART, len(w) - 1, f"{w[t]} {w[t + 1]}") for t in range(len(w) - 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, t int, part int, place long, grams int, gram string").withColumn("h", F.xxhash64("gram"))


def _hits(w: Column, pairs: list[str]) -> Column:
    """(i, gram) of every two consecutive words, joined by a space, that are one of the pairs."""
    firsts = sorted({p.split()[0] for p in pairs})
    pair = lambda x, i: F.when(x.isin(firsts), F.struct(i.alias("i"), F.concat(x, F.lit(" "), F.get(w, i + 1)).alias("gram")))
    return F.filter(F.transform(w, pair), lambda p: p["gram"].isin(pairs))


def runs(docs: DataFrame, slack: int = 3, share: float = 0.6, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """documents -> a row for each merged run of diagonals, and rows that only carry their document.

    row (a number of the document's row), doc_id, n_words, template, label, base, start, end (words,
    end exclusive), votes (different pairs of the template), share, found (whether it counts). Base
    phrases count only where all their words stand on one diagonal.
    """
    pairs = sorted({f"{a} {b}" for t in [t for t, _ in phrases] + [t for _, t in templates] for a, b in zip(t.split(), t.split()[1:])})
    each = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    rolled = each.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.inline_outer(_hits(F.col("w"), pairs))).withColumn("h", F.xxhash64("gram"))
    hits = rolled.join(F.broadcast(template_table(docs.sparkSession, phrases, templates)), ["h", "gram"], "left").repartition("row")
    key = ["row", "doc_id", "n_words", "template", "label", "base", "grams"]
    # a row for each diagonal, its votes by part of the template
    parts = hits.groupBy(*key, (F.col("i") - F.col("t")).alias("diagonal"), "part").agg(F.bit_or("place").alias("places"), F.min("i").alias("first"), F.max("i").alias("last"))
    votes = parts.groupBy(*key, "diagonal").agg(F.collect_list(F.struct("part", "places")).alias("parts"), F.sum(F.bit_count("places")).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    # single votes for a long template are noise: their rows stay to carry the document
    counts = F.col("base") | (F.col("n") > 1) | (F.col("grams") < 4)
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    run = Window.partitionBy("row", "template", "run")
    begun = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(near) > F.least(F.lit(slack), "grams")) | (F.col("first") > F.lag("diagonal").over(near) + F.col("grams"))
    merged = (
        votes.withColumn("template", F.when(counts, F.col("template")))
        .withColumn("new", F.coalesce(begun.cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(near))
        .withColumn("alone", F.when(F.max("last").over(run) + 2 - F.min("first").over(run) > 2 * (F.col("grams") + 1), F.col("diagonal")))
        .select(*key, "run", "alone", "first", "last", F.inline_outer("parts"))
    )
    return (
        merged.groupBy(*key, "run", "alone", "part").agg(F.bit_count(F.bit_or("places")).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy(*key, "run", "alone")
        .agg(F.sum("n").alias("votes"), F.min("first").alias("start"), (F.max("last") + 2).alias("end"))
        .withColumn("share", F.col("votes") / F.col("grams"))
        .withColumn("found", F.col("template").isNotNull() & F.when(F.col("base"), F.col("share") == 1).otherwise(F.col("share") >= share))
        .drop("grams", "run", "alone")
    )


def scan(docs: DataFrame, **options) -> DataFrame:
    """documents -> doc_id, template, label, base, start, end, votes, share of every licence that was found."""
    return runs(docs, **options).filter("found").drop("row", "n_words", "found")


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """documents -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest verified share (1 for a base phrase, 0 without any label).
    """
    base = F.col("found") & F.col("base")
    return (
        runs(docs, **options)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
