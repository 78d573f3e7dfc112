"""One row per (session, item): the grain most operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.order import global_positions

TYPES = (0, 1, 2)


def session_items(events: DataFrame) -> DataFrame:
    """Per session and item: newest time ``t<type>`` and count ``n<type>`` of each type.

    The non-null times are the log without duplicates (latest event per session,
    item and type), laid out in columns: one partial aggregation, then at most one
    row per distinct item of a session, however often it was touched.
    """
    latest = [F.expr(f"max(if(type = {t}, ts, null)) AS t{t}") for t in TYPES]
    counts = [F.expr(f"count_if(type = {t}) AS n{t}") for t in TYPES]
    return events.groupBy("session", "aid").agg(*latest, *counts)


def latest_per_type(events: DataFrame) -> DataFrame:
    """Duplicates dropped: the latest event per session, item and type."""
    return events.groupBy("session", "aid", "type").agg(F.max("ts").alias("ts"))


def present(side: str) -> str:
    """SQL number of event types a session item has, from its times."""
    return "(" + " + ".join(f"int(isnotnull({side}{t}))" for t in TYPES) + ")"


def item_counts(items: DataFrame) -> DataFrame:
    """Rows per item of the log without duplicates."""
    return items.groupBy("aid").agg(F.expr(f"sum({present('t')}) AS counts"))


def count_of(types: tuple[int, ...]) -> str:
    """SQL number of events of the given types in a ``session_items`` row."""
    return "(" + " + ".join(f"n{t}" for t in types) + ")"


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("counts"))


def dense_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """Consecutive ids from 0 in the order of ``column``."""
    placed = global_positions(df.select(column).distinct(), [F.col(column).asc()], out)
    return placed.withColumn(out, F.col(out).cast("int"))


def strict_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` with the other columns of ``table``, which has one row per key.

    A key without a row (a null key too) fails the job with its name instead of dropping
    the row. The check is part of the one join that fetches the values.
    """
    kinds = dict(table.dtypes)
    marked = table.withColumn("_known", F.lit(True))
    missing = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    found = {
        c: F.when(F.col("_known").isNotNull(), F.col(c)).otherwise(missing.cast(kinds[c]))
        for c in table.columns
        if c != key
    }
    return df.join(marked, key, "left").withColumns(found).drop("_known")
