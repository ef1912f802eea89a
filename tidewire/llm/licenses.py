"""License scans by diagonal voting: word pairs of documents joined to template positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2  # words of a rolling gram; the shortest phrase has two
NEAR = 2  # neighbouring diagonals this far apart belong to one place: words left out or put in
COVER = 0.7  # share of a notice's grams that a place must hold

# Phrases that give a label wherever their words stand consecutively.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices that may stand with changes.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}


def template_rows() -> list[tuple]:
    """(template, place, first word, second word, label, exact, number of grams) for every gram of every template."""
    rows = []
    for number, (text, label, exact) in enumerate([(t, x, True) for t, x in PHRASES.items()] + [(t, x, False) for t, x in NOTICES.items()]):
        words = text.split()
        rows += [(number, i, a, b, label, exact, len(words) - 1) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    schema = "template int, t_place int, t_one string, t_two string, t_label string, exact boolean, grams int"
    return spark.createDataFrame(template_rows(), schema).withColumn("t_hash", F.xxhash64("t_one", "t_two"))


def scan(docs: DataFrame) -> DataFrame:
    """Licenses per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling pair of words is joined by its hash to the templates' positions (a fixed table of a few hundred
    rows, so it is broadcast) and the words are compared. A hit votes for the diagonal document place - template
    place. A phrase stands where one diagonal has all its grams. Of a notice, diagonals at most NEAR apart
    form one place, which counts if it holds at least COVER of the grams and is not stretched beyond the notice's own length.
    ``score`` is the best coverage of a place. Null and empty texts have no words and no labels (''); rows are kept
    as they are, also repeated ones; an empty table gives an empty result; other columns are not read.
    """
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("words"))
    # The row number only tells rows apart on their way through the one exchange below.
    numbered = worded.withColumn("rid", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("long"))
    placed = numbered.select("rid", "doc_id", "n_words", "words", F.posexplode_outer("words").alias("place", "one"))
    grams = placed.select("rid", "doc_id", "n_words", "place", "one", F.get("words", F.col("place") + 1).alias("two"))
    met = F.broadcast(templates(docs.sparkSession))
    hits = grams.withColumn("hash", F.xxhash64("one", "two")).join(met, (F.col("hash") == F.col("t_hash")) & (F.col("one") == F.col("t_one")) & (F.col("two") == F.col("t_two")), "left")
    # The row of place 0 stands for the document if nothing is hit.
    kept = hits.where("template IS NOT NULL OR place IS NULL OR place = 0").select(
        "rid", "doc_id", "n_words", "template", "t_place", "t_label", "exact", "grams", (F.col("place") - F.col("t_place")).alias("diagonal")
    )
    document, facts = ["rid", "doc_id", "n_words"], ["template", "t_label", "exact", "grams"]
    diagonals = kept.repartition("rid").groupBy(*document, *facts, "diagonal").agg(F.collect_set("t_place").alias("held"))
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR).cast("int")
    merged = (
        diagonals.withColumn("starts", F.coalesce(starts, F.lit(0)))
        .withColumn("spot", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*document, *facts, "spot")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("covered"),
            F.sum(F.when(F.col("exact") & (F.size("held") == F.col("grams")), 1).otherwise(0)).alias("whole"),
            F.min(F.when(F.col("exact") & (F.size("held") == F.col("grams")), F.col("diagonal"))).alias("first"),
            F.max(F.when(F.col("exact") & (F.size("held") == F.col("grams")), F.col("diagonal"))).alias("last"),
            (F.max("diagonal") - F.min("diagonal")).alias("stretch"),
        )
    )
    share = F.col("covered") / F.col("grams")
    place = ~F.col("exact") & (share >= COVER) & (F.col("stretch") <= F.col("grams"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return merged.groupBy(*document).agg(
        F.sum("whole").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(F.when(F.col("whole") > 0, F.col("t_label"))).alias("base_labels"),
        joined(F.when((F.col("whole") > 0) | place, F.col("t_label"))).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).drop("rid")
