"""Licence phrases and notices in texts by diagonal voting."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch.llm.words import alnum_words, gram_hashes, word_hashes

GRAM = 2

# The phrases that count as base places, with their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Well-known licence notices, as published with the licences.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                   "GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


@dataclass(frozen=True)
class LicenseConfig:
    """A notice is found where neighbouring diagonals (at most ``shift`` apart) hold at least ``coverage`` of its
    different word pairs within a stretch at most ``stretch`` times its length."""

    shift: int = 4
    coverage: float = 0.6
    stretch: float = 1.5


def template_table(spark):
    """(_gram, template, place, length, label, base): every word pair of every template; a few hundred rows."""
    rows = []
    texts = [(text, label, True) for text, label in BASE_PHRASES] + [(text, label, False) for label, text in NOTICES]
    for number, (text, label, base) in enumerate(texts):
        words = alnum_words(text)
        for place, gram in enumerate(gram_hashes(word_hashes(words), GRAM).view("int64").tolist()):
            rows.append((gram, number, place, len(words), label, base))
    return spark.createDataFrame(
        rows, "_gram bigint, template int, place bigint, length bigint, label string, base boolean")


def _gram_batches(batches):
    for batch in batches:
        counts, grams = [], []
        for text in batch.column("_text").to_pylist():
            words = alnum_words(text)
            counts.append(len(words))
            grams.append(gram_hashes(word_hashes(words), GRAM).view("int64") if len(words) >= GRAM else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("doc_id"), pa.array(counts, pa.int64()),
             pa.array(grams, pa.list_(pa.int64()))], ["_row", "doc_id", "n_words", "_grams"])


def diagonals(docs, ids="doc_id", text="text"):
    """Votes: (_row, doc_id, n_words, template, diagonal, votes, places), one null template row per text.

    All rolling word pairs of all texts meet the template positions in one broadcast join (the templates are
    part of this module, so their size is known). Votes are added up inside the task that reads the text.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_gram_batches, f"_row bigint, doc_id {kind}, n_words bigint, _grams array<bigint>")
    grams = rows.select("_row", "doc_id", "n_words", F.posexplode_outer("_grams").alias("_at", "_gram"))
    met = grams.join(F.broadcast(template_table(docs.sparkSession)), "_gram", "left")
    return met.groupBy("_row", "doc_id", "n_words", "template", "length", "label", "base",
                       (F.col("_at") - F.col("place")).alias("diagonal")).agg(
        F.count("place").alias("votes"), F.collect_set("place").alias("places"))


def scan_licenses(docs, ids="doc_id", text="text", config=LicenseConfig()):
    """One row per row of ``docs``: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    A diagonal is the place in the text less the place in the template. A base phrase stands where all its
    word pairs vote for one diagonal; every such place counts, also overlapping ones. A notice is a cluster of
    neighbouring diagonals that vote for enough of its places. ``score`` is 1 with a base phrase, else the best coverage of a
    notice, else 0. Diagonals with a single vote count too, so words put in between do not hide a notice. Very
    long texts are read whole; equal places of several templates all count. Texts without words (null, empty) have no places and empty labels; repeated rows and null
    ids keep rows of their own. No rows, no result rows. Other columns of ``docs`` are not looked at.
    """
    votes = diagonals(docs, ids, text)
    whole = F.col("base") & (F.col("votes") == F.col("length") - 1)
    kept = votes.filter(F.col("template").isNull() | whole | ~F.col("base"))
    places = kept.withColumn("_start", F.when(whole, F.col("diagonal")))
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > config.shift, F.lit(True))
    clusters = places.withColumn("_apart", apart.cast("int")).withColumn("_cluster", F.sum("_apart").over(along))
    # What lies inside a cluster may be longer than a notice, so its best part within ``stretch`` counts.
    drift = F.greatest(F.col("length") * (config.stretch - 1), F.lit(1.0))
    reach = Window.partitionBy("_row", "template", "_cluster").orderBy("_scaled").rangeBetween(0, 1000)
    together = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(reach))))
    spans = clusters.withColumn("_scaled", F.floor(F.col("diagonal") * 1000 / drift)).withColumn(
        "_coverage", F.when(~F.col("base"), together / (F.col("length") - 1)))
    based, notice = F.col("_start").isNotNull(), F.col("_coverage") >= config.coverage
    found = spans.groupBy("_row", "doc_id", "n_words").agg(
        F.count("_start").alias("n_base"), F.min("_start").alias("first_word"), F.max("_start").alias("last_word"),
        F.array_sort(F.collect_set(F.when(based, F.col("label")))).alias("_base"),
        F.array_sort(F.collect_set(F.when(based | notice, F.col("label")))).alias("_all"),
        F.coalesce(F.max(F.when(based, F.lit(1.0)).when(notice, F.col("_coverage"))), F.lit(0.0)).alias("score"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join("_all", ",").alias("labels"), "score")
