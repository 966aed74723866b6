"""License scan by diagonal voting, in DataFrame operations only.

Every word k-gram of a text is hashed and joined to the positions it has in the license templates. A hit votes for
the diagonal (text position less template position); a license that stands in a text piles its votes on one
diagonal, or on neighbouring ones where words were put in or left out. Votes are checked word by word, summed by
diagonal, neighbouring diagonals are merged, and a merged span counts where it covers enough of the template.

The templates are constants of this module (about a hundred k-grams), so their table is broadcast at a fixed size.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

#: Exact phrases, matched by word bigrams: label by phrase.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Longer notices, matched by runs of notice_k() words: label by text.
NOTICES = {
    "licensed under cc by nc 4.0": "cc-by-nc",
    "licensed under cc by sa 4.0": "cc-by-sa",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit",
    "licensed under the apache license version 2.0 you may not use this file except in compliance with the license": "apache",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
    "all rights reserved": "proprietary",
}
#: Diagonals at most this far apart belong to one occurrence.
DIAGONAL_GAP = 3
#: Share of a notice's k-grams that an occurrence must have.
MIN_COVER = 0.6
#: What separates words.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def notice_k(words: int) -> int:
    """Words in a k-gram of a notice of so many words.

    Four; three for 8 to 12 words, where a changed word in the middle would spoil too many of four. The notices of 7
    words differ from each other by one, which must tell them apart.
    """
    return min(words, 3 if 8 <= words <= 12 else 4)


def _grams(spark: SparkSession, templates: list[tuple[list[str], str, int, bool]], k: int) -> DataFrame:
    """hash, and the places that the k-gram has: (tid, tpos, k, total, exact, label, gram). A template's number is its place in the list."""
    rows = []
    for tid, (words, label, own, exact) in enumerate(templates):
        total = len(words) - own + 1
        rows += [(tid, i, k, total, exact, label, words[i : i + k]) for i in range(total) if own == k]
    df = spark.createDataFrame(rows, "tid int, tpos int, k int, total int, exact boolean, label string, gram array<string>")
    at = F.struct("tid", "tpos", "k", "total", "exact", "label", "gram")
    return df.groupBy(F.xxhash64(*[F.col("gram")[i] for i in range(k)]).alias(f"h{k}")).agg(F.collect_list(at).alias(f"at{k}"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per text and occurrence: (id, text_key, n_words, tid, label, exact, start, end, cover); one row with a null tid for each text too.

    text_key is a hash of the text: rows equal in id and text are one document. A null text is empty and has no word.
    start and end are word positions from 0, end exclusive.
    """
    spark = docs.sparkSession
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    templates = [(WORD.findall(p), label, 2, True) for p, label in phrases.items()]
    templates += [(words, label, notice_k(len(words)), False) for words, label in ((WORD.findall(n), label) for n, label in notices.items())]
    if any(len(words) < 2 for words, *_ in templates):
        raise ValueError("a phrase or notice needs 2 words")
    sizes = sorted({k for _, _, k, _ in templates})
    tables = {k: _grams(spark, templates, k) for k in sizes}
    w = F.col("w")
    first, last = F.element_at(w, 1) == "", F.element_at(w, -1) == ""
    split = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).select("id", F.xxhash64("t").alias("text_key"), F.split("t", SEPARATORS).alias("w"))
    lead = F.when(first, 1).otherwise(0)
    n_words = F.when(F.size(w) == 1, F.when(first, 0).otherwise(1)).otherwise(F.size(w) - lead - F.when(last, 1).otherwise(0))
    at = split.select("id", "text_key", "w", n_words.cast("long").alias("n_words"), lead.alias("lead"), F.posexplode("w").alias("p", "x"))
    word = lambda i: F.get(w, F.col("p") + i) if i else F.col("x")
    hashed = lambda k: F.xxhash64(*[F.lower(word(i)) for i in range(k)])
    found = at
    for k, grams in tables.items():
        found = found.withColumn(f"h{k}", hashed(k)).join(F.broadcast(grams), f"h{k}", "left")
    voted = [F.col(f"at{k}") for k in sizes]
    found = found.where(reduce(lambda x, y: x | y, (v.isNotNull() for v in voted), F.col("p") == 0))
    none = F.array().cast(tables[sizes[0]].schema[f"at{sizes[0]}"].dataType)
    hits = found.select(
        "id", "text_key", "n_words", (F.col("p") - F.col("lead")).cast("long").alias("p"),
        F.array(*[F.translate(word(i), UPPER, LOWER) for i in range(sizes[-1])]).alias("here"),
        F.explode_outer(F.concat(*[F.coalesce(v, none) for v in voted])).alias("v"),
    )
    # A hash may collide and lower() folds a few letters beyond A-Z: the words themselves decide.
    same = F.slice("here", 1, F.col("v.k")) == F.col("v.gram")
    votes = hits.select("id", "text_key", "n_words", F.when(same, F.col("v")).alias("v"), "p").repartition("id", "text_key")
    key = ["id", "text_key"]
    by_diagonal = votes.groupBy(*key, "v.tid", (F.col("p") - F.col("v.tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.first("v.label").alias("label"), F.first("v.exact").alias("exact"), F.first("v.total").alias("total"), F.first("v.k").alias("k"), F.collect_set("v.tpos").alias("tpos")
    )
    # Neighbouring diagonals make one occurrence; a phrase must stand word for word, so each of its diagonals stays alone.
    order = Window.partitionBy(*key, "tid").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > DIAGONAL_GAP
    merged = by_diagonal.withColumn("new", (F.coalesce(far, F.lit(True)) | F.coalesce("exact", F.lit(True))).cast("int")).withColumn("run", F.sum("new").over(order))
    spans = merged.groupBy(*key, "tid", "run").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("total").alias("total"),
        F.min(F.col("diagonal") + F.array_min("tpos")).alias("start"), F.max(F.col("diagonal") + F.array_max("tpos") + F.col("k")).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"),
    )
    cover = F.size("tpos") / F.col("total")
    good = F.when(F.col("exact"), F.size("tpos") == F.col("total")).otherwise(cover >= MIN_COVER)
    real: Column = F.col("tid").isNotNull() & good
    return spans.select(*key, "n_words", *[F.when(real, F.col(c)).alias(c) for c in ("tid", "label", "exact", "start", "end")], F.when(real, cover).alias("cover"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template found (1 for a whole phrase), 0 without any. Rows equal in id and text
    are one document; an id with several texts has a row for each. An empty table gives none.
    """
    spans = license_spans(docs, id_col, text_col)
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    base = F.coalesce("exact", F.lit(False))
    return spans.groupBy("id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.lit(True)).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every whole text of documents."""
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
