"""License scans: diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a document is joined by its hash to the places where the pair stands
in a template; where three words are left in the template, the third must agree too, and the words
themselves are compared. A match votes for a diagonal, its place in the text less its place in the
template. Votes are added up by document, template and diagonal; diagonals that lie near each other,
as after a word put in or left out, are joined into one span. Then the span is verified. A base phrase, and any
template of at most SHORT words, must match in full on one diagonal; a longer notice counts if its span has votes
for at least half of its pairs and for all pairs with a deciding word (a number, or a word that tells it from another
clause or licence of its family), and isn't spread over more than twice its length.

Nulls and edges: a null text is empty; texts of fewer than two words match nothing. Repeated rows come back as
often as they stand there. An empty table gives no row. Words are lower-cased as a whole; base phrases
are ASCII, for which this is the same as lowering ASCII alone. Very long texts are taken whole. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import native as N
from .common import prepare

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Openings of well-known public licence notices, and lines that name a licence.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
]
#: Diagonals as near as this belong together.
DRIFT = 3
LEAST_SHARE, MOST_SPREAD, SHORT = 0.5, 2, 12
#: Words, beside numbers, that tell a notice from the others of its family.
DECIDING = {"by", "nc", "sa", "nd", "lesser", "affero", "later", "attribution", "noncommercial", "sharealike", "mozilla", "mit", "apache"}


def templates(spark, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """A row for each pair of neighbouring words of a template; as many as the parameters say, so small enough to send.

    ``whole`` marks those that must match in full, ``decides`` the pairs that must be there, ``deciding`` says how many these are.
    """
    rows = []
    for base, listed in ((True, phrases.items()), (False, ((t, label) for label, t in notices))):
        for text, label in listed:
            w = text.split()
            tells = [x.isdigit() or x in DECIDING for x in w]
            decides = [a or b for a, b in zip(tells, tells[1:], strict=False)]
            rows += [(base, label, text, len(w), base or len(w) <= SHORT, sum(decides), decides[i], i, " ".join(w[i : i + 2]), " ".join(w[i : i + 3]) if i + 3 <= len(w) else None) for i in range(len(w) - 1)]
    made = spark.createDataFrame(rows, "base boolean, label string, template string, size int, whole boolean, deciding int, decides boolean, at int, two string, three string")
    return made.withColumn("h", F.xxhash64("two"))


def spans(docs: DataFrame, **which) -> DataFrame:
    """(k1, k2, base, label, first, last, share): verified spans of words and the share of the template that voted."""
    rows = N.keyed(docs).select(*N.KEYS, N.words(F.col("text")).alias("w")).where("size(w) > 1")
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 3), " "))
    places = rows.select(*N.KEYS, F.posexplode(grams).alias("pos", "gram")).withColumn("pair", F.substring_index("gram", " ", 2)).withColumn("h", F.xxhash64("pair"))
    met = places.join(F.broadcast(templates(docs.sparkSession, **which)), "h").where("pair = two and (three is null or gram = three)")
    of = ["base", "label", "template", "size", "whole", "deciding"]
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")  # repeated rows have one key, so that places are counted, not rows
    votes = met.groupBy(*N.KEYS, *of, diagonal).agg(F.count_distinct("pos").alias("votes"), F.count_distinct(F.when(F.col("decides"), F.col("pos"))).alias("decided"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy(*N.KEYS, "template", "base").orderBy("diagonal")
    fresh = F.col("whole") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(True))
    joined = votes.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(along))
    merged = joined.groupBy(*N.KEYS, *of, "run").agg(F.sum("votes").alias("votes"), F.sum("decided").alias("decided"), F.min("first").alias("first"), (F.max("last") + 1).alias("last"))
    share = F.least(F.lit(1.0), F.col("votes") / (F.col("size") - 1))
    ok = F.when(F.col("whole"), F.col("votes") == F.col("size") - 1).otherwise((share >= LEAST_SHARE) & (F.col("decided") >= F.col("deciding")) & (F.col("last") - F.col("first") + 1 <= MOST_SPREAD * F.col("size")))
    return merged.where(ok).select(*N.KEYS, "base", "label", "first", "last", share.alias("share"))


def scan(docs: DataFrame, **which) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every document."""
    prepare(docs.sparkSession)
    base = F.col("base")
    found = spans(docs, **which).groupBy(*N.KEYS).agg(
        F.sum(base.cast("long")).alias("n"),
        F.min(F.when(base, F.col("first"))).alias("a"),
        F.max(F.when(base, F.col("first"))).alias("z"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("own"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("all"),
        F.max("share").alias("share"),
        F.array_sort(F.collect_set(F.struct("first", "last", "label"))).alias("spans"),
    )
    rows = N.keyed(docs).select(*N.KEYS, "doc_id", F.size(N.words(F.col("text"))).cast("long").alias("n_words"))
    none = F.lit("")
    return rows.join(found, N.KEYS, "left").select(
        "doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_base"), F.col("a").cast("long").alias("first_word"), F.col("z").cast("long").alias("last_word"), F.coalesce("own", none).alias("base_labels"), F.coalesce("all", none).alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"), "spans"
    )
