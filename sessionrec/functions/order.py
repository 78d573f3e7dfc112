"""Order inside groups: ranks, top-k, positions, following rows.

Every order is total (ties broken by id), so results do not depend on how rows
are partitioned. Ordinary groups use one window. A group may be far larger than a
task can sort, so functions that need a full sort take ``hot``: the keys of such
groups. Their rows are range-partitioned by the same order, numbered per slice and
shifted by the sizes of the slices before, so that no task holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionrec.sources.stages import materialize

# A window task sorts this many narrow rows without trouble.
MAX_GROUP_ROWS = 2_000_000


def hot_groups(
    df: DataFrame, keys: list[str], max_rows: int = MAX_GROUP_ROWS
) -> DataFrame | None:
    """Keys of groups with more than ``max_rows`` rows, or None when there are none.

    At most rows / max_rows keys can qualify. Counting is partially aggregated, so a hot key costs nothing extra here.
    """
    hot = df.groupBy(*keys).count().filter(F.col("count") > max_rows).select(*keys)
    return None if hot.isEmpty() else materialize(hot, "hot")


def _split(df: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = hot.columns
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null; ``right`` gives its other columns."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same).drop(*[f"_right_{k}" for k in keys])


def _sliced(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """0-based position by range slices.

    Slice numbers come from sampled bounds, so they are written once and read by
    both the row side and the size side.
    """
    by = [F.col(k) for k in keys] + order
    slices = materialize(
        df.repartitionByRange(*by).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        slices.groupBy(*keys, "_slice")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = slices.withColumn("_in", F.row_number().over(inside) - 1)
    # One offset per group and slice: joined by both, which spreads a hot group.
    return (
        _join_null_safe(numbered, offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_slice", "_before", "_in")
    )


def global_positions(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based position in the whole table without a single-task sort."""
    return _sliced(df, [], order, out)


def sliced_positions(
    df: DataFrame, keys: list[str], order: list[Column], out: str
) -> DataFrame:
    """Position in few large groups (ranking lists of a whole catalogue)."""
    return _sliced(df, keys, order, out)


def positions(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row in its group (bigint)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    number = (F.row_number().over(window) - 1).cast("bigint")
    if hot is None:
        return df.withColumn(out, number)
    cold_rows, hot_rows = _split(df, hot)
    return cold_rows.withColumn(out, number).unionByName(_sliced(hot_rows, keys, order, out))


def following(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    columns: list[str],
    count: int,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Each row with each of its next ``count`` rows, as ``lag`` and ``next_<column>``.

    One window gives all leads at once. Rows of hot groups meet by position
    instead: an equi-join on (group, position), which spreads over all tasks.
    """
    keep = df.columns
    window = Window.partitionBy(*keys).orderBy(*order)

    def by_window(rows: DataFrame) -> DataFrame:
        leads = F.array(
            *[
                F.struct(
                    F.lit(i).alias("lag"),
                    *[F.lead(c, i).over(window).alias(f"next_{c}") for c in columns],
                    F.lead(F.lit(True), i).over(window).alias("_there"),
                )
                for i in range(1, count + 1)
            ]
        )
        return (
            rows.withColumn("_lead", leads)
            .withColumn("_lead", F.explode("_lead"))
            .filter(F.col("_lead._there"))
            .select(*keep, "_lead.lag", *[f"_lead.next_{c}" for c in columns])
        )

    if hot is None:
        return by_window(df)
    cold_rows, hot_rows = _split(df, hot)
    placed = materialize(_sliced(hot_rows, keys, order, "_pos"), "placed")
    later = placed.select(
        *keys,
        *[F.col(c).alias(f"next_{c}") for c in columns],
        "_pos",
        F.explode(F.sequence(F.lit(1), F.lit(count))).alias("lag"),
    ).withColumn("_pos", F.col("_pos") - F.col("lag"))
    joined = placed.join(later, [*keys, "_pos"]).select(
        *keep, "lag", *[f"next_{c}" for c in columns]
    )
    return by_window(cold_rows).unionByName(joined)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None):
    """The first k rows of each group.

    Spark limits each map task to its own first k rows of a group before the
    shuffle, so a hot group sends k rows per task, not all of them.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def best_first(score: str = "score", item: str = "aid") -> list[Column]:
    """Candidate order: score descending, item id ascending."""
    return [F.col(score).desc(), F.col(item).asc()]


def newest_first() -> list[Column]:
    """Event order: newest first."""
    return [F.col("ts").desc(), F.col("eid").desc()]


def oldest_first() -> list[Column]:
    """Event order: oldest first."""
    return [F.col("ts").asc(), F.col("eid").asc()]


def score_ranks(
    df: DataFrame,
    keys: list[str],
    score: str = "score",
    item: str = "aid",
    rank: str = "rank",
    min_rank: str = "min_rank",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Ordinal rank and min rank (ties share the best place), highest score first."""
    by_score = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    full = Window.partitionBy(*keys).orderBy(*best_first(score, item))

    def by_window(rows: DataFrame) -> DataFrame:
        return rows.withColumn(rank, F.row_number().over(full).cast("int")).withColumn(
            min_rank, F.rank().over(by_score).cast("int")
        )

    if hot is None:
        return by_window(df)
    cold_rows, hot_rows = _split(df, hot)
    placed = materialize(_sliced(hot_rows, keys, best_first(score, item), "_pos"), "ranked")
    best = placed.groupBy(*keys, score).agg((F.min("_pos") + 1).cast("int").alias(min_rank))
    # Rows without a score rank last, as by the window, and tie with each other.
    ranked = _join_null_safe(placed, best, [*keys, score]).withColumn(
        rank, (F.col("_pos") + 1).cast("int")
    )
    return by_window(cold_rows).unionByName(ranked.drop("_pos"))


def last_events(events: DataFrame) -> DataFrame:
    """The newest event of each session: an aggregate, no sort."""
    return (
        events.groupBy("session")
        .agg(F.max(F.struct("ts", "eid", "aid", "type")).alias("_e"))
        .select("session", "_e.aid", "_e.ts", "_e.type", "_e.eid")
    )


def item_lists(
    events: DataFrame,
    max_length: int = 1000,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Items of each session, oldest first, in lists of at most ``max_length``.

    ``part`` numbers the lists of a session; concatenated they are its full list.
    """
    placed = positions(
        events.select("session", "aid", "ts", "eid"), ["session"], oldest_first(), "_pos", hot
    )
    part = F.floor(F.col("_pos") / max_length).cast("int")
    packed = F.array_sort(F.collect_list(F.struct("_pos", "aid")))
    return (
        placed.groupBy("session", part.alias("part"))
        .agg(packed.alias("_l"))
        .select("session", "part", F.transform("_l", lambda e: e["aid"]).alias("aids"))
    )
