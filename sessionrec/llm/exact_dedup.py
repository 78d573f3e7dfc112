"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its content says so: at the first sentence end after ``MIN_CHUNK``
characters, at ``MAX_CHUNK`` at the latest. The distinct chunks are moved once, to prove
that a chunk's 64-bit number names one content only; a number that does not is extended
by the rank of the content among those that share it. A document is then its recipe, the
ordered list of its chunk identifiers, and equal texts are found by grouping recipes.
Documents of any length move as 8 bytes per chunk, and only once are texts compared.

Defined cases: null text is the empty text (recipe without chunks); of equal texts the
smallest doc_id stays, a null doc_id only if there is no other; of repeated rows with
that id exactly one is kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import SPACE, documents, texts, with_rows
from sessionrec.sources.stages import materialize

MIN_CHUNK = 512
MAX_CHUNK = 8192
SENTENCE_END = "[.!?;。！？؟।]"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one blank."""
    return F.regexp_replace(text, SPACE, " ")


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text as an array of content-defined chunks; joined they are the text."""
    pattern = f"(?s).{{{least},{most - 1}}}?{SENTENCE_END}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_number(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(
    docs: DataFrame,
    number=chunk_number,
    least: int = MIN_CHUNK,
    most: int = MAX_CHUNK,
) -> DataFrame:
    """One row per document: doc_id, _row, text_sha256, chunk numbers, marks.

    ``marks`` holds (position, ordinal) of the chunks whose number is ambiguous.
    Numbers and marks together are equal exactly when the normalised texts are.
    """
    plain = texts(docs).select("doc_id", normalised(F.col("text")).alias("text"))
    cut = plain.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text"), least, most).alias("chunks")
    )
    table = with_rows(
        cut.select("doc_id", "text_sha256", F.transform("chunks", number).alias("numbers")), "recipes"
    )
    pieces = cut.select(F.explode("chunks").alias("chunk")).withColumn("number", number(F.col("chunk")))
    contents = pieces.select("number", "chunk").distinct()
    shared = materialize(
        contents.groupBy("number").count().filter("count > 1").select("number"), "shared-numbers"
    )
    none = F.array().cast("array<struct<position:int,ordinal:bigint>>")
    if shared.isEmpty():
        return table.withColumn("marks", none)
    # The content of an ambiguous chunk is its second half of identity.
    marks = (
        cut.select("doc_id", "text_sha256", F.posexplode("chunks").alias("position", "chunk"))
        .withColumn("number", number(F.col("chunk")))
        .join(shared, "number")
        .select(
            F.struct("doc_id", "text_sha256").alias("key"), "number", "chunk", "position"
        )
    )
    ordinals = (
        marks.select("number", "chunk").distinct()
        .groupBy("number")
        .agg(F.array_sort(F.collect_list("chunk")).alias("contents"))
        .select("number", F.posexplode("contents").alias("ordinal", "chunk"))
    )
    by_doc = (
        marks.join(ordinals, ["number", "chunk"])
        .groupBy("key")
        .agg(
            F.array_sort(
                F.collect_set(F.struct("position", F.col("ordinal").cast("bigint").alias("ordinal")))
            ).alias("marks")
        )
    )
    same = F.struct(table["doc_id"], table["text_sha256"]).eqNullSafe(by_doc["key"])
    return materialize(
        table.join(by_doc, same, "left").select(table["*"], F.coalesce("marks", none).alias("marks")),
        "marked-recipes",
    )


def exact_dedup(docs: DataFrame, number=chunk_number, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    table = recipes(docs, number, least, most)
    # The empty recipe is a value like any other; ids beyond null come first.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    groups = materialize(
        table.groupBy("numbers", "marks").agg(F.min(order).alias("first"), F.count("*").alias("group_size")),
        "recipe-groups",
    )
    # Both sides are plain tables, so adaptive execution splits a hot recipe.
    return table.join(groups, ["numbers", "marks"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first._row")).alias("kept"),
        "text_sha256",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
