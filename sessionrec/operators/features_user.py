"""Session and session-item features from the visible history.

"First" is the newest and "last" the oldest event, as published. Options give the
documented reading where the published behaviour differs from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.order import following, newest_first, oldest_first, positions
from sessionrec.operators.features_item import ts_stats
from sessionrec.sources.events import EVENT_GROUPS, is_type


def by_group(events: DataFrame, groups: tuple[str, ...] = tuple(EVENT_GROUPS)) -> DataFrame:
    """Each event once per event group it belongs to, as column ``grp``."""
    members = ", ".join(f"if({is_type(EVENT_GROUPS[g])}, '{g}', null)" for g in groups)
    return events.selectExpr("*", f"explode(array_compact(array({members}))) AS grp")


def _day(ts: str) -> str:
    """SQL date of epoch seconds in UTC, whatever the session's time zone."""
    return f"date_from_unix_date(int(floor({ts} / 86400)))"


def user_inter_dow(events: DataFrame) -> DataFrame:
    """Day of week (Monday 0) of the newest and oldest event per group, -1 if none."""
    edges = [
        F.expr(
            f"tinyint(coalesce(weekday({_day(f'{pick}(if({is_type(t)}, ts, null))')}), -1))"
            f" AS user_{which}_{g}_dow"
        )
        for g, t in EVENT_GROUPS.items()
        for which, pick in (("first", "max"), ("last", "min"))
    ]
    return events.groupBy("session").agg(*edges)


def user_inter_num(events: DataFrame) -> DataFrame:
    """Events per group, -1 if none."""
    counts = [
        F.expr(f"int(coalesce(nullif(count_if({is_type(t)}), 0), -1)) AS user_{g}_num")
        for g, t in EVENT_GROUPS.items()
    ]
    return events.groupBy("session").agg(*counts)


def user_inter_ts_diff(events: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Min, mean, std and max gap between consecutive events of a group, -1 if none."""
    gaps = following(
        by_group(events).select("session", "grp", "ts", "eid"),
        ["session", "grp"],
        oldest_first(),
        ["ts"],
        1,
        hot,
    )
    stats = [
        F.expr(
            f"coalesce(double({how}(if(grp = '{g}', next_ts - ts, null))), -1D)"
            f" AS user_{g}_ts_diff_{name}"
        )
        for g in EVENT_GROUPS
        for name, how in (
            ("min", "min"), ("mean", "avg"), ("std", "stddev_samp"), ("max", "max")
        )
    ]
    # Sessions of a single event have no gap; they keep a row of -1.
    sessions = events.select("session").distinct()
    known = gaps.groupBy("session").agg(*stats)
    return sessions.join(known, "session", "left").na.fill(-1.0)


def user_inter_ts_hour(events: DataFrame, by_type: bool = False) -> DataFrame:
    """Mean hour of day, cut to an integer.

    As published all groups hold the mean over all events; ``by_type`` keeps to the
    events of the group (-1 if none).
    """
    hour = "pmod(ts, 86400) div 3600"  # UTC
    hours = [
        F.expr(
            f"tinyint(coalesce(avg({f'if({is_type(t)}, {hour}, null)' if by_type else hour}), -1D))"
            f" AS user_{g}_ts_hour_mean"
        )
        for g, t in EVENT_GROUPS.items()
    ]
    return events.groupBy("session").agg(*hours)


def user_inter_ts_stats(events: DataFrame) -> DataFrame:
    return ts_stats(events, "session", "user_inter")


def user_ts_diff(events: DataFrame) -> DataFrame:
    """Length of a session and distance of its ends to the ends of the log."""
    whole = events.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    ends = events.groupBy("session").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))

    return ends.withColumn("log", whole).selectExpr(
        "session",
        "int(hi - lo) AS user_ts_diff",
        "int(lo - log.lo) AS user_min_all_min_ts_diff",
        "int(hi - log.lo) AS user_max_all_min_ts_diff",
        "int(log.hi - lo) AS user_min_all_max_ts_diff",
        "int(log.hi - hi) AS user_max_all_max_ts_diff",
    )


def user_item_first_inter_rank(
    events: DataFrame, by_type: bool = False, hot: DataFrame | None = None
) -> DataFrame:
    """Place of an item's newest / oldest event in its session, per group, from 0.

    One descending numbering serves both ends: counted from the oldest event, an
    event at place p of n is at n - 1 - p. As published only the newest place over
    all and over buying events carries data, the rest is -1.
    """
    groups = tuple(EVENT_GROUPS) if by_type else ("inter", "buy")
    grouped = by_group(events, groups).select("session", "aid", "grp", "ts", "eid")
    placed = positions(grouped, ["session", "grp"], newest_first(), "place", hot)
    ends = placed.groupBy("session", "aid", "grp").agg(
        F.min("place").alias("newest"), F.max("place").alias("oldest")
    )
    sizes = grouped.groupBy("session", "grp").agg(F.count(F.lit(1)).alias("n"))

    def rank(which, g):
        place = "newest" if which == "first" else "n - 1 - oldest"
        if g not in groups or (which == "last" and not by_type):
            value = "-1"
        else:
            value = f"coalesce(max(if(grp = '{g}', {place}, null)), -1)"
        return F.expr(f"int({value}) AS user_item_{which}_{g}_rank")

    return (
        ends.join(sizes, ["session", "grp"])
        .groupBy("session", "aid")
        .agg(*[rank(which, g) for which in ("first", "last") for g in EVENT_GROUPS])
    )


def user_item_is_first_inter(events: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Flags: the item is that of the newest / oldest event of a group.

    As published a session has one row, its newest item; ``all_pairs`` gives every
    item that is at some end.
    """
    ends = [(which, g) for g in EVENT_GROUPS for which in ("first", "last")]
    picked = events.groupBy("session").agg(
        *[
            F.expr(
                f"{'max' if which == 'first' else 'min'}"
                f"(if({is_type(EVENT_GROUPS[g])}, struct(ts, eid, aid), null)).aid AS {which}_{g}"
            )
            for which, g in ends
        ]
    )
    items = "first_inter"
    if all_pairs:
        names = ", ".join(f"{which}_{g}" for which, g in ends)
        items = f"explode(array_distinct(array_compact(array({names}))))"
    flags = [
        f"tinyint(coalesce({which}_{g} = aid, false)) AS user_item_is_{which}_{g}"
        for which, g in ends
    ]
    return picked.selectExpr("*", f"{items} AS aid").selectExpr("session", "aid", *flags)
