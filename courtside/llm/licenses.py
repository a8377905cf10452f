"""License scans by diagonal voting, in DataFrame functions only.

The words of a document (runs of ASCII letters and digits and of all other non-ASCII characters, lower-cased) are hashed in
rolling k-grams and joined with the places of the same k-grams in templates. A hit votes for its diagonal: its place in the
document less that in the template. Short phrases count where all their grams vote for one diagonal. For long notices,
neighbouring diagonals are merged, as words put in or left out shift the rest; a cluster whose hits cover LEAST_COVER of the template's
grams, each place counted once (a bit each: templates have up to 63 grams), over a span not much longer than the template, is a find. Every hit is verified word by word.

The templates are constants of this module, so their broadcast is bounded. Null and empty texts have no words and no labels; very long
texts are scanned whole; each row votes for itself, so repeated rows give equal rows and rows that share a doc_id or have none a row
each; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening words of well-known notices.
NOTICES = {
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
SHORT, LONG = 2, 4
LEAST_COVER, NEAR, STRETCH = 0.5, 3, 1.5


def _templates() -> list[tuple[int, str, bool, list[str]]]:
    texts = [(label, True, t) for t, label in PHRASES.items()] + [(label, False, t) for label, t in NOTICES.items()]
    out = [(n, label, base, t.split()) for n, (label, base, t) in enumerate(texts)]
    if max(len(ws) for *_, ws in out) > 63 + SHORT - 1:
        raise ValueError("a template has over 63 places")
    return out


def words_of(text):
    # lower() rather than A-Z alone: no other letter becomes one of a template, nor a separator
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(spark: SparkSession, k: int, base: bool) -> DataFrame:
    rows = [(" ".join(ws[p : p + k]), n, p) for n, _, b, ws in _templates() if b == base for p in range(len(ws) - k + 1)]
    grams = spark.createDataFrame(rows, "gram string, tpl int, pos int").withColumn("words", F.split("gram", " "))
    return grams.select(F.xxhash64(*(F.col("words")[j] for j in range(k))).alias(f"h{k}"), F.struct("tpl", "pos", F.col("words").alias("gram")).alias("place")).groupBy(f"h{k}").agg(F.collect_list("place").alias(f"at{k}"))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), spans of the notices, score."""
    spark = docs.sparkSession
    i = F.col("i")
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    at = docs.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("i"))
    for k in (SHORT, LONG):
        at = at.withColumn(f"h{k}", F.xxhash64(*(F.get("words", i + j) for j in range(k))))
    for k, base in ((SHORT, True), (LONG, False)):
        at = at.join(F.broadcast(_grams(spark, k, base)), f"h{k}", "left")
    # the first position stays without a hit too, so that each document has a row
    hit = at.where("i = 0 or at2 is not null or at4 is not null").select(
        "row", "doc_id", F.size("words").alias("n_words"), "i",
        F.explode_outer(F.when(F.col("at2").isNotNull() | F.col("at4").isNotNull(), F.filter(F.concat(F.coalesce("at2", F.array()), F.coalesce("at4", F.array())), lambda p: F.slice("words", i + 1, F.size(p.gram)) == p.gram))).alias("p"),
    )
    about = spark.createDataFrame([(n, label, base, len(ws) - (SHORT if base else LONG) + 1, len(ws)) for n, label, base, ws in _templates()], "tpl int, label string, base boolean, grams int, size int")
    votes = hit.groupBy("row", "doc_id", F.col("p.tpl").alias("tpl"), (i - F.col("p.pos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.coalesce(F.bit_or(F.expr("shiftleft(1L, p.pos)")), F.lit(0).cast("long")).alias("places"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    votes = votes.join(F.broadcast(about), "tpl", "left")
    # neighbouring diagonals of a notice become one cluster
    by_diagonal = Window.partitionBy("row", "doc_id", "tpl").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR, F.lit(True))
    parts = votes.withColumn("new", apart.cast("int")).withColumn("cluster", F.sum("new").over(by_diagonal))
    clusters = parts.groupBy("row", "doc_id", "tpl", "cluster").agg(
        F.max("n_words").alias("n_words"), F.bit_count(F.bit_or("places")).alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("diagonal"),
        *(F.first(c).alias(c) for c in ("label", "base", "grams", "size")))
    cover = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    is_base = F.col("base") & (F.col("votes") == F.col("grams"))
    is_notice = ~F.col("base") & (cover >= LEAST_COVER) & (F.col("hi") - F.col("lo") + LONG <= F.col("size") * STRETCH)
    return clusters.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(is_base | is_notice, F.col("label")))).alias("labels"),
        F.array_sort(F.collect_list(F.when(is_notice, F.struct(F.col("lo").alias("start"), (F.col("hi") + LONG).alias("end"), "label")))).alias("spans"),
        F.coalesce(F.max(F.when(is_base | is_notice, cover)), F.lit(0.0)).alias("score")).drop("row")
