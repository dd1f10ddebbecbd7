"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency over all documents, rarest first.  A block that
holds at least ``o`` of a template's tokens must share one of the template's first
``size - o + 1`` tokens in that order (prefix filter), have at least ``o`` tokens itself
(length filter), and the shared token's place in both must leave room for ``o`` in all
(positional filter).  What passes is verified by counting the tokens in common.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut_lineage, query, table, word_bytes

MAX_TEMPLATE_TOKENS = 1_000_000

# Phrases that count wherever their words stand in a row.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# The words of common notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
            " public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "copyright all rights reserved"),
)


def words_of(text: str | None) -> list[str]:
    """The words of a whole text, A-Z lower-cased."""
    words = b" ".join(word_bytes(text)).decode()
    return words.split(" ") if words else []


def phrase_starts(spaced: str, phrase: str) -> list[int]:
    """Word numbers at which ``phrase`` starts in a text given as words between single spaces."""
    needle, out, at = f" {phrase} ", [], spaced.find(f" {phrase} ")
    words, counted = 0, 0
    while at >= 0:
        words += spaced.count(" ", counted, at)
        counted = at
        out.append(words)
        at = spaced.find(needle, at + 1)
    return out


def token_counts(df: DataFrame, text_col: str, vocabulary: frozenset[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in all texts (the vocabulary bounds the result)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for text in batch.column(0):
                total.update(filter(vocabulary.__contains__, words_of(text.as_py())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["token", "n"]
            )

    counted = df.select(text_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {row["token"]: row["n"] for row in counted.collect()}


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
    containment: float = 0.8,
    across_lines: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    Blocks are windows of twice the longest template's words that overlap by half, over
    each line by itself, so a notice on one line is never cut out of all of them.  With
    ``across_lines`` such windows over the words of the whole text, line ends included,
    come after them, so one wrapped over lines is not either.  A block
    matches a template if it holds at least ``containment`` of its distinct words;
    ``matches`` lists (block, label, containment).  ``score`` is 1 where a phrase
    stands, else the largest containment found, else 0.  A null text is an empty
    one; rows repeated or without an id each have their own result.
    """
    token_sets = [(label, sorted(set(words_of(text)))) for label, text in templates]
    token_sets = [(label, tokens) for label, tokens in token_sets if tokens]
    vocabulary = frozenset(token for _, tokens in token_sets for token in tokens)
    if sum(len(tokens) for _, tokens in token_sets) > MAX_TEMPLATE_TOKENS:
        raise ValueError("too many template tokens to send to every task")
    spark = df.sparkSession
    counts = token_counts(df, text_col, vocabulary)
    rank = {token: at for at, token in enumerate(sorted(vocabulary, key=lambda x: (counts.get(x, 0), x)))}
    index, opening = [], set()
    least, span = 1 << 30, 1
    for number, (label, tokens) in enumerate(token_sets):
        ordered = sorted(rank[token] for token in tokens)
        need = math.ceil(containment * len(ordered) - 1e-9)
        least, span = min(least, need), max(span, len(words_of(templates[number][1])), len(ordered))
        for place, token in enumerate(ordered[: len(ordered) - need + 1]):
            index.append((token, number, label, place, need, ordered))
            opening.add(token)
    named = [(phrase, label) for phrase, label in phrases]

    id_type = df.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>,"
        " blocks array<struct<block: int, tokens: array<int>>>"
    )
    block_type = pa.list_(pa.struct([("block", pa.int32()), ("tokens", pa.list_(pa.int32()))]))
    openers = frozenset(token for token, at in rank.items() if at in opening)

    def windows(text: str) -> Iterator[list[str]]:
        lines = [words for words in map(words_of, text.split("\n")) if words]
        whole = [[word for words in lines for word in words]] if across_lines and len(lines) > 1 else []
        for words in lines + whole:
            for first in range(0, max(1, len(words) - span), span):
                yield words[first : first + 2 * span]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_base, first, last, labels, blocks = [], [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                words = words_of(text)
                spaced = f" {' '.join(words)} "
                places = {phrase: phrase_starts(spaced, phrase) for phrase, _ in named}
                starts = [at for found in places.values() for at in found]
                n_words.append(len(words))
                n_base.append(len(starts))
                first.append(min(starts, default=None))
                last.append(max(starts, default=None))
                labels.append(sorted({label for phrase, label in named if places[phrase]}))
                found = []
                if not openers.isdisjoint(words):
                    for number, window in enumerate(windows(text)):
                        tokens = vocabulary.intersection(window)
                        if len(tokens) >= least and not openers.isdisjoint(tokens):
                            found.append({"block": number, "tokens": sorted(rank[token] for token in tokens)})
                blocks.append(found)
            longs = [pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *longs, pa.array(labels, pa.list_(pa.string())), pa.array(blocks, block_type)],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
            )

    rows = cut_lineage(
        df.select(id_col, text_col).mapInArrow(scan, schema).withColumn("_row", F.monotonically_increasing_id())
    )
    blocks = (
        rows.select("_row", F.explode("blocks").alias("b"))
        .select("_row", "b.block", "b.tokens", F.size("b.tokens").alias("size"))
        .select("*", F.posexplode(F.slice("tokens", F.lit(1), F.col("size") - F.lit(least - 1))).alias("at", "token"))
    )
    lookup = spark.createDataFrame(
        index, "token int, template int, label string, place int, need int, template_tokens array<int>"
    )
    total = F.size("template_tokens")
    room = F.lit(1) + F.least(total - F.col("place") - 1, F.col("size") - F.col("at") - 1)
    matches = (
        blocks.join(lookup, "token")
        .filter((F.col("size") >= F.col("need")) & (room >= F.col("need")))
        .dropDuplicates(["_row", "block", "template"])
        .withColumn("shared", F.size(F.array_intersect("tokens", "template_tokens")))
        .filter(F.col("shared") >= F.col("need"))
        .select("_row", F.struct("block", "label", (F.col("shared") / total).alias("containment")).alias("match"))
        .groupBy("_row").agg(F.sort_array(F.collect_list("match")).alias("matches"))  # of one text
    )
    empty = F.array().cast("array<struct<block: int, label: string, containment: double>>")
    out = rows.join(matches, "_row", "left").withColumn("matches", F.coalesce("matches", empty))
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    best = F.array_max(F.transform("matches", lambda m: m["containment"]))
    return out.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        "matches",
    )


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    return scan_licenses(table(spark, sf_dir, "documents"), across_lines=True).drop("matches")
