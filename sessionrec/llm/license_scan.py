"""License scan: phrases word by word, and an exact set-similarity join with templates.

Documents are cut into blocks of ``BLOCK`` words, each starting ``STRIDE`` words after the
one before, so a template of up to BLOCK - STRIDE words lies whole in some block. Longer
templates are met by longer blocks: a power of two of words apart, at least the template's
length, and twice that long. A block matches a template if it holds at least ``THRESHOLD``
of the template's distinct words. A template of at most ``SHORT`` of them also needs every
word that no other label's template has ("mit", not any four of "released under the mit
license").

The join is exact. Words are ordered by the number of documents that hold them, rarest
first. To reach the needed overlap a block must hold one of the template's rarest words
(prefix filter), have enough distinct template words at all (length filter), and at the
place of the shared word have enough words left on both sides (positional filter); the
pairs left are counted in full. Only words of some template can overlap, so blocks carry
those alone. The postings of the template prefixes are bounded by the templates given,
so they are sent to every task; block words are not.

Defined cases: null text is empty; repeated rows are judged apart and alike; documents
without matches have no labels and score zero; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import alnum_words, documents, texts, with_rows

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Characteristic sentences of common licences, by label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "no part of this publication may be reproduced without prior written permission"),
)

THRESHOLD = 0.8
BLOCK = 64
STRIDE = 32
SHORT = 8

BASE_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "seen array<int>, blocks array<array<array<int>>>"
)


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) wherever a phrase's words stand one after the other."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        wanted = b" " + b" ".join(phrase) + b" "
        at = line.find(wanted)
        if at < 0:
            continue
        counted, word = 0, 0
        while at >= 0:
            word += line.count(b" ", counted, at)
            counted = at
            found.append((word, label))
            at = line.find(wanted, at + 1)
    return found


def block_words(numbers: list[int], block: int, stride: int) -> list[list[int]]:
    """Distinct template words (numbers from 0) of each block."""
    out = []
    for start in range(0, max(1, len(numbers) - stride), stride):
        held = set(numbers[start : start + block])
        held.discard(-1)
        out.append(list(held))
    return out


def block_size(words: int, block: int, stride: int) -> tuple[int, int]:
    """(block, stride) of a template of so many words."""
    if words <= block - stride:
        return block, stride
    stride = 1 << (words - 1).bit_length()
    return 2 * stride, stride


def scan_documents(
    docs: DataFrame, vocabulary: list[bytes], sizes: list[tuple[int, int, int]], phrases=PHRASES
) -> DataFrame:
    """Phrase places of each document, and its blocks by size.

    ``sizes`` are (block, stride, least template words of a block that counts).
    """
    fewest = min((least for _, _, least in sizes), default=1)
    number = {w: i for i, w in enumerate(vocabulary)}
    wanted = [(alnum_words(p), label) for p, label in phrases.items()]

    def run(batches):
        get = number.get
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = alnum_words(text)
                places = phrase_places(words, wanted)
                starts = [p for p, _ in places]
                numbers = [get(w, -1) for w in words]
                seen = set(numbers)
                seen.discard(-1)
                blocks = [[] for _ in sizes]
                if len(seen) >= fewest:
                    for held, (block, stride, least) in zip(blocks, sizes):
                        held += [b for b in block_words(numbers, block, stride) if len(b) >= least]
                out.append(
                    (
                        doc_id,
                        len(words),
                        len(places),
                        min(starts, default=None),
                        max(starts, default=None),
                        sorted({label for _, label in places}),
                        list(seen),
                        blocks,
                    )
                )
            columns = list(zip(*out)) if out else [()] * 8
            types = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.list_(pa.int32())))]
            names = [c.split()[0] for c in BASE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts(docs).mapInArrow(run, BASE_SCHEMA)


def own_words(templates: list[tuple[str, list[int]]], short: int) -> list[list[int]]:
    """For each template of at most ``short`` words those that no other label's template has."""
    labels: dict[int, set[str]] = {}
    for label, words in templates:
        for w in words:
            labels.setdefault(w, set()).add(label)
    return [[w for w in words if len(labels[w]) == 1] if len(words) <= short else [] for _, words in templates]


def containment_join(
    blocks: DataFrame, templates: list[tuple[str, list[int], list[int]]], frequency: dict[int, int], threshold: float
) -> DataFrame:
    """(_row, label, score) of the blocks (_row, words) that hold enough of a template.

    ``templates`` are (label, distinct word numbers, those that a block must hold).
    """
    spark = blocks.sparkSession
    numbers = {w for _, words, _ in templates for w in words}
    order = {w: i for i, w in enumerate(sorted(numbers, key=lambda w: (frequency.get(w, 0), w)))}
    postings, sets = [], []
    for t, (label, words, own) in enumerate(templates):
        ranks = sorted(order[w] for w in words)
        needed = math.ceil(threshold * len(ranks) - 1e-9)
        sets.append((t, label, ranks, sorted(order[w] for w in own)))
        postings += [(r, t, i, len(ranks), needed) for i, r in enumerate(ranks[: len(ranks) - needed + 1])]
    prefix = spark.createDataFrame(postings, "rank int, template int, i int, size int, needed int")
    whole = spark.createDataFrame(sets, "template int, label string, ranks array<int>, own array<int>")
    ranked = F.array(*[F.lit(order.get(w, -1)) for w in range(max(numbers, default=0) + 1)])
    sorted_blocks = blocks.select(
        "_row", F.array_sort(F.transform("words", lambda w: F.get(ranked, w))).alias("held")
    )
    tokens = sorted_blocks.select("_row", "held", F.posexplode("held").alias("j", "rank"))
    # The prefix postings and templates are bounded by the templates given.
    candidates = (
        tokens.join(F.broadcast(prefix), "rank")
        .filter(F.size("held") >= F.col("needed"))
        .filter(1 + F.least(F.col("size") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("needed"))
        .join(F.broadcast(whole), "template")
    )
    overlap = F.size(F.array_intersect("held", "ranks"))
    held_own = F.size(F.array_intersect("held", "own")) == F.size("own")
    return candidates.filter((overlap >= F.col("needed")) & held_own).select("_row", "label", (overlap / F.col("size")).alias("score"))


def license_scan(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases=PHRASES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    stride: int = STRIDE,
    short: int = SHORT,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    sets = [(label, sorted(set(alnum_words(t)))) for label, t in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    numbered = [(label, [number[w] for w in words]) for label, words in sets]
    by_size: dict[tuple[int, int], list] = {}
    for (label, words), own, (_, text) in zip(numbered, own_words(numbered, short), templates):
        by_size.setdefault(block_size(len(alnum_words(text)), block, stride), []).append((label, words, own))
    sizes = [(*size, min(math.ceil(threshold * len(w) - 1e-9) for _, w, _ in held)) for size, held in by_size.items()]
    table = with_rows(scan_documents(docs, vocabulary, sizes, phrases), "license-words")
    # Documents per template word: one row per word of the templates.
    counts = table.select(F.explode("seen").alias("w")).groupBy("w").count().collect()
    frequency = {r["w"]: r["count"] for r in counts}
    found = [
        containment_join(table.select("_row", F.explode(F.get("blocks", F.lit(k))).alias("words")), held, frequency, threshold)
        for k, held in enumerate(by_size.values())
    ]
    nothing = table.select("_row", F.lit("").alias("label"), F.lit(0.0).alias("score")).limit(0)
    matches = (
        reduce(DataFrame.union, found, nothing)
        .groupBy("_row")
        .agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    )
    none = F.array().cast("array<string>")
    base = F.col("base_labels")
    return table.drop("blocks", "seen").join(matches, "_row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
