"""Item features from the training log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.functions import columns as C
from sessionrec.functions.order import sliced_positions
from sessionrec.operators.sessions import count_of, session_items
from sessionrec.sources.events import DAY, EVENT_GROUPS, is_type, max_ts

# Trailing windows in days, conversions (name, from type, to type).
WINDOWS = (3, 7, 14, 21)
CONVERSIONS = (("click_to_cart", 0, 1), ("click_to_order", 0, 2), ("cart_to_order", 1, 2))


def _aged(events: DataFrame) -> DataFrame:
    """Events with their distance to the newest one, ``age`` in seconds."""
    return events.select("aid", "type", (max_ts(events) - F.col("ts")).alias("age"))


def _counts(events: DataFrame) -> DataFrame:
    """Counts of all windows and groups in one pass over the widest window."""
    counts = [
        F.expr(f"int(count_if(age <= {d * DAY} AND {is_type(t)})) AS item_{g}_num_{d}d")
        for d in WINDOWS
        for g, t in EVENT_GROUPS.items()
    ]
    return _aged(events).filter(f"age <= {max(WINDOWS) * DAY}").groupBy("aid").agg(*counts)


def item_inter_num(events: DataFrame) -> DataFrame:
    """Events per item in the trailing windows, per event group."""
    return _counts(events)


def item_inter_rank(events: DataFrame) -> DataFrame:
    """Place of an item by those counts (1 = most), 0 where it has no such event.

    The twenty rankings are ranked together, range-partitioned by (ranking, count),
    so no single task sorts the catalogue.
    """
    rankings = [f"item_{g}_num_{d}d" for d in WINDOWS for g in EVENT_GROUPS]
    long = ", ".join(f"struct('{c}' AS ranking, {c} AS n)" for c in rankings)
    counted = _counts(events).selectExpr("aid", f"inline(array({long}))").filter("n > 0")
    placed = sliced_positions(
        counted, ["ranking"], [F.col("n").desc(), F.col("aid").asc()], "place"
    )
    ranks = [
        F.expr(
            f"int(coalesce(max(if(ranking = '{c}', place + 1, null)), 0))"
            f" AS {c.replace('_num_', '_rank_')}"
        )
        for c in rankings
    ]
    return placed.groupBy("aid").agg(*ranks)


def ts_stats(events: DataFrame, key: str, prefix: str) -> DataFrame:
    """Mean, min, max and std of the time stamps of a key, standardised by the table.

    The std is standardised like the others, mean included.
    """
    whole = events.agg(
        F.struct(F.avg("ts").alias("mean"), F.stddev_samp("ts").alias("std"))
    ).scalar()
    stats = events.groupBy(key).agg(
        F.avg("ts").alias("mean"),
        F.min("ts").alias("min"),
        F.max("ts").alias("max"),
        F.stddev_samp("ts").alias("std"),
    )
    return stats.select(
        key,
        *[
            C.standardize(F.col(s).cast("double"), whole["mean"], whole["std"]).alias(
                f"{prefix}_ts_{s}"
            )
            for s in ("mean", "min", "max", "std")
        ],
    )


def item_inter_ts_stats(events: DataFrame) -> DataFrame:
    return ts_stats(events, "aid", "item_inter")


def item_multi_inter_prob(events: DataFrame) -> DataFrame:
    """Share of the sessions with the item that touched it more than once, per group."""
    shares = [
        F.expr(
            f"coalesce(avg(if({n} > 0, int({n} > 1), null)), -1D) AS item_multi_{g}_prob"
        )
        for g, n in ((g, count_of(types)) for g, types in EVENT_GROUPS.items())
    ]
    return session_items(events).groupBy("aid").agg(*shares)


def item_type_to_type_prob(events: DataFrame, recent: bool = False) -> DataFrame:
    """Conversion ratios per item; -1 where nothing can convert.

    As published the events before the trailing windows count; ``recent`` counts
    those within them.
    """

    def inside(d):
        return f"age {'<=' if recent else '>'} {d * DAY}"

    widest = max(WINDOWS) if recent else min(WINDOWS)
    counts = [
        F.expr(f"count_if({inside(d)} AND type = {t}) AS n{t}_{d}")
        for d in WINDOWS
        for t in (0, 1, 2)
    ]
    ratios = [
        f"coalesce(try_divide(n{b}_{d}, n{a}_{d}), -1D) AS item_{name}_prob_{d}d"
        for d in WINDOWS
        for name, a, b in CONVERSIONS
    ]
    counted = _aged(events).filter(inside(widest)).groupBy("aid").agg(*counts)
    return counted.selectExpr("aid", *ratios)


def type_pivot(events: DataFrame) -> DataFrame:
    """Events per item, one column per type; 0 where none."""
    pivoted = events.groupBy("aid").pivot("type", [0, 1, 2]).count()
    return pivoted.na.fill(0).select(
        "aid", *[F.col(str(t)).alias(f"type_{t}") for t in (0, 1, 2)]
    )


def outer_joined_counts(events: DataFrame) -> DataFrame:
    """Counts per group joined outer on the item: the shape of chained window tables."""
    out = None
    for g, types in EVENT_GROUPS.items():
        counted = events.filter(is_type(types)).groupBy("aid").count()
        part = counted.withColumnRenamed("count", f"item_{g}_num")
        out = part if out is None else out.join(part, "aid", "full_outer")
    return out.na.fill(0)
