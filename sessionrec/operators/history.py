"""Session history as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.order import hot_groups, score_ranks
from sessionrec.operators.sessions import count_of, session_items
from sessionrec.sources.events import EVENT_GROUPS, of_group


def history_candidates(events: DataFrame, group: str, hot: DataFrame | None = None) -> DataFrame:
    """Items a session touched in one event group; score = number of such events."""
    counted = (
        of_group(events, group)
        .groupBy("session", "aid")
        .agg(F.count(F.lit(1)).cast("float").alias("score"))
    )
    named = counted.withColumn("cg", F.lit(f"last_{group}"))
    return score_ranks(named, ["session"], hot=hot)


def all_history_candidates(events: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """All five groups from one aggregation of the log."""
    groups = ", ".join(
        f"struct('last_{g}' AS cg, cast({count_of(types)} AS float) AS score)"
        for g, types in EVENT_GROUPS.items()
    )
    long = (
        session_items(events)
        .selectExpr("session", "aid", f"inline(array({groups}))")
        .filter("score > 0")
    )
    return score_ranks(long, ["session", "cg"], hot=hot)


def hot_sessions(events: DataFrame) -> DataFrame | None:
    """Sessions too long for one window task."""
    return hot_groups(events, ["session"])
