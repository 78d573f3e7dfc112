"""Weighted recall at k and NDCG at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionrec.functions.order import best_first, top_k

# Share of each target in the total, cut-offs of the recall curve.
TARGET_WEIGHTS = {0: 0.1, 1: 0.3, 2: 0.6}
TARGET_NAMES = {0: "click", 1: "cart", 2: "order"}
CUTOFFS = (20, 50, 100, 200, 300)


def top_lists(scored: DataFrame, k: int = 20, score: str = "pred_score") -> DataFrame:
    """The first k items of each session as an ordered list ``y_pred``."""
    ranked = top_k(scored.select("session", "aid", score), ["session"], best_first(score), k, "_r")
    packed = F.array_sort(F.collect_list(F.struct("_r", "aid")))  # at most k
    return (
        ranked.groupBy("session")
        .agg(packed.alias("_l"))
        .select("session", F.transform("_l", lambda e: e["aid"]).alias("y_pred"))
    )


def for_all_types(lists: DataFrame) -> DataFrame:
    """The same lists as prediction of every event type."""
    types = F.explode(F.array(*[F.lit(t).cast("tinyint") for t in TARGET_NAMES]))
    return lists.select("session", "y_pred", types.alias("type"))


def popular_items(events: DataFrame, event_type: int, k: int = 20) -> DataFrame:
    """One row: the k most frequent items of an event type, ``items``."""
    counted = (
        events.filter(F.col("type") == event_type)
        .groupBy("aid")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "aid")
        .limit(k)
    )
    packed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "aid")))
    return counted.agg(packed.alias("_l")).select(
        F.transform("_l", lambda e: e["aid"]).alias("items")
    )


def list_hits(
    labels: DataFrame,
    lists: DataFrame,
    k: int = 20,
    popular_clicks: DataFrame | None = None,
    popular_orders: DataFrame | None = None,
) -> DataFrame:
    """Hits and truth size of each label row.

    A label without prediction counts as an empty list. Short lists are filled up:
    clicks from ``popular_clicks``, everything else (and clicks, if only that list
    is given) from ``popular_orders``. Filled-in items may repeat predicted ones.
    """
    joined = labels.join(lists, ["session", "type"], "left")
    nothing = F.array().cast("array<int>")
    predicted = F.coalesce("y_pred", nothing)
    if popular_orders is not None or popular_clicks is not None:
        orders = popular_orders.scalar() if popular_orders is not None else nothing
        clicks = popular_clicks.scalar() if popular_clicks is not None else orders
        filler = F.when(F.col("type") == 0, clicks).otherwise(orders)
        predicted = F.concat(predicted, filler)
    first = F.slice(predicted, 1, k)
    truth = F.col("ground_truth")
    return joined.select(
        "session",
        "type",
        F.size(F.array_intersect(truth, first)).alias("hits"),
        F.least(F.size(truth), F.lit(k)).alias("gt_num"),
        F.col("y_pred").isNull().cast("int").alias("no_prediction"),
    )


def _weighted(per_type):
    parts = [TARGET_WEIGHTS[t] * F.coalesce(per_type(t), F.lit(0.0)) for t in TARGET_WEIGHTS]
    return parts[0] + parts[1] + parts[2]


def recall_at_k(
    labels: DataFrame,
    lists: DataFrame,
    k: int = 20,
    popular_clicks: DataFrame | None = None,
    popular_orders: DataFrame | None = None,
) -> DataFrame:
    """One row: recall per target, weighted total and share without prediction.

    A target without labels has no recall (null) and adds nothing to the total.
    """
    hits = list_hits(labels, lists, k, popular_clicks, popular_orders)

    def ratio(t):
        mine = F.col("type") == t
        return F.try_divide(
            F.sum(F.when(mine, F.col("hits"))), F.sum(F.when(mine, F.col("gt_num")))
        )

    return hits.agg(
        *[ratio(t).alias(f"recall_{n}") for t, n in TARGET_NAMES.items()],
        _weighted(ratio).alias("recall"),
        F.avg("no_prediction").alias("null_ratio"),
    )


def recall_curve(
    labels: DataFrame,
    candidates: DataFrame,
    cutoffs: tuple[int, ...] = CUTOFFS,
    rank: str = "rank",
) -> DataFrame:
    """Recall of one generator at several cut-offs in one record.

    Works on ranked rows, not lists: each true item meets its rank once, and every
    cut-off is a conditional sum over the same join.
    """
    covered = candidates.select("session").distinct().withColumn("_has", F.lit(1))
    truth = labels.join(covered, "session", "left").select(
        "session",
        "type",
        "_has",
        F.size("ground_truth").alias("_n"),
        F.posexplode_outer(F.array_distinct("ground_truth")).alias("_i", "aid"),
    )
    placed = candidates.filter(F.col(rank) <= max(cutoffs)).select(
        "session", "aid", F.col(rank).alias("_r")
    )
    once = F.coalesce("_i", F.lit(0)) == 0  # counts each label row once

    def hits(t, k):
        return F.sum(F.when((F.col("type") == t) & (F.col("_r") <= k), 1).otherwise(0))

    def sizes(t, k):
        return F.sum(F.when((F.col("type") == t) & once, F.least("_n", F.lit(k))))

    def ratio(t, k):
        return F.try_divide(hits(t, k), sizes(t, k))

    first = cutoffs[0]
    return truth.join(placed, ["session", "aid"], "left").agg(
        *[ratio(t, first).alias(f"recall_{n}_{first}") for t, n in TARGET_NAMES.items()],
        *[_weighted(lambda t, k=k: ratio(t, k)).alias(f"recall_{k}") for k in cutoffs],
        F.avg(F.when(once, F.when(F.col("_has").isNull(), 1).otherwise(0))).alias("null_ratio"),
    )


def ndcg_at_k(scored: DataFrame, target: str, k: int = 20, score: str = "pred_score") -> DataFrame:
    """Mean NDCG over the sessions that hold at least one positive (one row).

    ``scored`` has the merged candidates of a session, at most a few per generator.
    """
    window = Window.partitionBy("session").orderBy(*best_first(score))
    gain = 1.0 / F.log2(F.col("_r") + 1)
    per_session = (
        scored.withColumn("_r", F.row_number().over(window))
        .groupBy("session")
        .agg(
            F.sum(F.when((F.col("_r") <= k) & (F.col(target) == 1), gain).otherwise(0.0)).alias("dcg"),
            F.sum(F.col(target).cast("int")).alias("_p"),
        )
        .filter("_p > 0")
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("_p"), F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda s, r: s + 1.0 / F.log2(r.cast("double") + 1.0),
    )
    return per_session.agg(
        F.avg(F.col("dcg") / ideal).alias("ndcg"), F.count(F.lit(1)).alias("sessions")
    )
