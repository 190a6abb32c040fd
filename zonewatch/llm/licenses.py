"""Licence phrases and notices in texts, by diagonal voting. DataFrame and SQL functions only.

All 2-grams of a text's words are joined by hash with the 2-grams of short templates, and the words
compared. A hit at word `pos` of the text and `at` of the template votes for the diagonal pos - at: a
template that stands at word d puts all its votes on diagonal d. Votes are counted by text, template
and diagonal, partly before the shuffle. A phrase is where one diagonal has all its votes. A notice may
have words more or less, which moves the rest of it to a neighbouring diagonal: the votes of diagonals
within `slack` are merged, and verified as the share of the notice's 2-grams found there, each once.
All of a merged span lies within `slack` words of where the notice's words would stand.

Templates are a parameter and part of the program (some hundred short rows), so they are broadcast; a
2-gram found in a third of all texts costs its own rows only, and rows are grouped by text. Each row of
the table is a text of its own, whatever its id, so repeated rows give equal results. Null and empty
texts have no words. Kept columns travel in a struct, so their names clash with nothing. A text without a
hit has one marker row, so it isn't lost; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linedup import lower_ascii

#: Everything below 80 that isn't a digit or a small letter parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count exactly as they are, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices that count with words more, less or other, with their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("either version 3 of the license or at your option any later version", "gpl-3.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by-4.0"),
)


def grams(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str, str]]:
    """(template, at, a, b) of all 2-grams; a template of one word has none and is refused."""
    out = []
    for number, (words, _) in enumerate(templates):
        w = words.split()
        if len(w) < 2:
            raise ValueError(f"a template has at least two words: {words!r}")
        out += [(number, at, a, b) for at, (a, b) in enumerate(zip(w, w[1:]))]
    return out


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", phrases=PHRASES, notices=NOTICES,
         threshold: float = 0.75, slack: int = 2) -> DataFrame:
    """(kept, n_words, hits, below) of every row: kept is a struct of its kept columns, hits an array of
    (label, exact, start, similarity) in order, a phrase at each of its places, a notice at the best
    diagonal of each neighbourhood with a similarity of at least `threshold`; below is the best
    similarity of a notice that isn't a hit, 0 without any."""
    spark, templates = docs.sparkSession, (*phrases, *notices)
    known = spark.createDataFrame([*grams(templates), (-1, 0, "", "")], "template int, at int, ta string, tb string")
    known = known.withColumn("th", F.xxhash64("ta", "tb"))  # words are never empty: the last row is the marker's alone
    info = spark.createDataFrame([(i, label, i < len(phrases), len(words.split()) - 1) for i, (words, label) in enumerate(templates)],
                                 "template int, label string, exact boolean, n_grams int")

    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*keep).alias("kept"), F.filter(F.split(text, BETWEEN), lambda w: w != "").alias("words"))
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b"))
    found = F.transform("words", lambda w, i: pair(w, F.get("words", i + 1)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "kept", F.size("words").cast("long").alias("n_words"),
                       F.concat(F.array(pair(F.lit(""), F.lit(""))), found).alias("grams"))
    votes = rows.select("row", "kept", "n_words", F.posexplode("grams").alias("pos", "g")).join(
        F.broadcast(known), (F.col("g.h") == F.col("th")) & (F.col("g.a") == F.col("ta")) & (F.col("g.b") == F.col("tb")))
    diagonals = votes.groupBy("row", "template", (F.col("pos") - 1 - F.col("at")).alias("start")).agg(
        F.first("kept").alias("kept"), F.first("n_words").alias("n_words"), F.collect_set("at").alias("ats"))

    near = Window.partitionBy("row", "template").orderBy("start").rangeBetween(-slack, slack)
    merged = diagonals.join(F.broadcast(info), "template", "left").withColumn(
        "covered", F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near)))))
    order = F.struct("covered", F.size("ats").alias("own"), (-F.col("start")).alias("place"))
    merged = merged.withColumn("best", F.max(order).over(near))
    similarity = F.when(F.col("exact"), F.size("ats")).otherwise(F.col("covered")) / F.col("n_grams")
    hit = F.when(F.col("exact"), F.col("similarity") == 1).otherwise((F.col("similarity") >= threshold) & (F.col("best.place") == -F.col("start")))
    merged = merged.withColumn("similarity", similarity).withColumn("hit", F.coalesce(hit, F.lit(False)))
    span = F.struct("label", "exact", F.col("start").cast("long").alias("start"), "similarity")
    return merged.groupBy("row").agg(
        F.first("kept").alias("kept"), F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), span))).alias("hits"),
        F.coalesce(F.max(F.when(~F.col("hit") & ~F.col("exact"), F.col("similarity"))), F.lit(0.0)).alias("below")).drop("row")
