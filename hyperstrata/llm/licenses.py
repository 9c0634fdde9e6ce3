"""License scan by diagonal voting.

Every document is cut into words; a word k-gram is coded by the numbers of its
words in the vocabulary of the templates, without collisions (a k-gram with any
other word equals no template k-gram and gets no code). Spark joins all coded
k-grams to the template positions with the same code. A match votes for the
diagonal "place in the document minus place in the template"; neighbouring
diagonals of one template, at most ``gap`` apart, are merged, so that a few words
more or less inside a text do not split it. A merged span is verified by the
share of the template's k-grams that it holds: all of them on one diagonal for
phrases (so the words stand consecutively), at least ``COVER`` for texts, in a
span of at most ``STRETCH`` times the template's length. Where the merged span of a text
fails, each of its diagonals is verified by itself, so that repeats of a short notice,
whose diagonals are neighbours, are found one by one.

Scale: one pass; texts are not shuffled. The template table is fixed in code
(its size is known) and broadcast. A row of the join is a k-gram of template
words; votes are pre-aggregated by (row, template, diagonal) before the
shuffle, and all later groups are within one document.

Cases: null and empty texts have no words, counts 0 and null first and last
words; repeated rows are scanned each by itself; ids may be null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.llm.common import LOWER_ASCII

K = 3
COVER, STRETCH = 0.6, 1.5

# The phrases of the contract and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# The words of public license notices and their labels.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: str | None) -> list[bytes]:
    return _WORDS((text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII))


def templates(phrases=PHRASES, texts=TEXTS) -> list[dict]:
    return [{"template": i, "label": label, "words": text.encode().split(), "phrase": i < len(phrases)} for i, (label, text) in enumerate([*phrases, *texts])]


def vocabulary(found: list[dict]) -> dict[bytes, int]:
    return {w: i + 1 for i, w in enumerate(sorted({w for t in found for w in t["words"]}))}


def gram_codes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the k-grams whose words all have a number over 0."""
    if len(numbers) < K:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    code, whole = np.zeros(len(numbers) - K + 1, "i8"), np.ones(len(numbers) - K + 1, bool)
    for j in range(K):
        part = numbers[j : len(numbers) - K + 1 + j]
        code, whole = (code << 20) | part, whole & (part > 0)
    at = np.flatnonzero(whole)
    return at, code[at]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """One row per document: id, n_words, score and ``spans``, an array of

    (template, label, phrase, start, end, coverage) of verified spans; words are
    counted from 0 and ``end`` is exclusive. ``score`` is the largest share of a
    template's k-grams found on merged diagonals, verified or not.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    known = templates(phrases, texts)
    numbers = vocabulary(known)

    def code(batches):
        import pyarrow as pa

        gram = pa.struct([("place", pa.int64()), ("code", pa.int64())])
        get = numbers.get
        for batch in batches:
            counts, offsets, places, codes = [], [0], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                at, coded = gram_codes(np.fromiter((get(w, 0) for w in found), "i8", len(found)))
                counts.append(len(found))
                places.append(at)
                codes.append(coded)
                offsets.append(offsets[-1] + len(at))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(places) if places else []), pa.array(np.concatenate(codes) if codes else [])], fields=list(gram)) if offsets[-1] else pa.array([], gram)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, "int64"), pa.ListArray.from_arrays(pa.array(offsets, "int32"), flat)], names=[id_col, "n_words", "grams"])

    coded = docs.select(id_col, text_col).mapInArrow(code, f"{id_col} {kind}, n_words long, grams array<struct<place: bigint, code: bigint>>")
    grams = coded.withColumn("_row", F.monotonically_increasing_id()).select("_row", id_col, "n_words", F.inline_outer("grams"))

    positions = []
    for t in known:
        at, codes = gram_codes(np.array([numbers[w] for w in t["words"]], "i8"))
        positions += [(t["template"], t["label"], t["phrase"], 0 if t["phrase"] else 3, len(t["words"]), len(at), int(a), int(c)) for a, c in zip(at, codes)]
    table = spark.createDataFrame(positions, "template int, label string, phrase boolean, gap int, t_words int, t_grams int, t_place long, code long")

    about = ["template", "label", "phrase", "gap", "t_words", "t_grams"]
    votes = (
        grams.join(F.broadcast(table), "code", "left")
        .groupBy("_row", id_col, "n_words", *about, (F.col("place") - F.col("t_place")).alias("diagonal"))
        .agg(F.collect_set("t_place").alias("held"), F.min("place").alias("start"), (F.max("place") + K).alias("end"))
    )
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("gap")
    islands = votes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("_row", id_col, "n_words", *about, "_island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("_held"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.collect_list(F.struct("start", "end", F.size("held").alias("held"))).alias("_diagonals"),
    )
    coverage = F.coalesce(F.col("_held") / F.col("t_grams"), F.lit(0.0))
    verified = F.when(F.col("phrase"), F.col("_held") == F.col("t_grams")).otherwise((F.col("coverage") >= COVER) & (F.col("end") - F.col("start") <= STRETCH * F.col("t_words")))
    span = F.struct("template", "label", "phrase", "start", "end", "coverage")
    alone = F.filter("_diagonals", lambda d: ~F.col("phrase") & (d["held"] / F.col("t_grams") >= COVER) & (d["end"] - d["start"] <= STRETCH * F.col("t_words")))
    each = F.transform(alone, lambda d: F.struct("template", "label", "phrase", d["start"].alias("start"), d["end"].alias("end"), (d["held"] / F.col("t_grams")).alias("coverage")))
    return (
        spans.withColumn("coverage", coverage)
        .groupBy("_row", id_col, "n_words")
        .agg(F.max("coverage").alias("score"), F.sort_array(F.flatten(F.collect_list(F.when(verified, F.array(span)).otherwise(each)))).alias("spans"))
        .select(id_col, "n_words", "score", "spans")
    )
