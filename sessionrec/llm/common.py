"""Helpers shared by the training-data operators.

Operators take any DataFrame with an integer id and a text column. They select the
columns they need first, so other columns, whatever their names, never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.sources.stages import materialize

# ASCII white space: blank and tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

# A-Z to a-z; every other ASCII character outside 0-9 and a-z separates words.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``; null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def alnum_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8.

    All bytes of a non-ASCII character are 128 or more, so bytes split as code points do.
    """
    return text.encode().translate(_LETTERS).split()


def with_rows(df: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """``df`` written once to the shared folder with a number for each row.

    Rows are numbered by partition when they are written, so later reads of the table,
    also by a retried task, see the same numbers. Equal rows get different numbers.
    """
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), name)

