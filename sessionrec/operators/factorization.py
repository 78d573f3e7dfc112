"""Factorisation of consecutive items and of session-item events.

Training pairs, weights and eligibility are DataFrame jobs. Vectors come from Spark
ML's ALS (default), from BPR in mini-batches over disjoint blocks of vectors
(``operators.block_bpr``), or from full-batch BPR epochs with Adam, in which every step
is a join with the current vectors, a gradient per Arrow batch and a sum per id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import cos, pi

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.functions import columns as C
from sessionrec.functions.order import following, newest_first
from sessionrec.operators.block_bpr import block_bpr
from sessionrec.operators.sessions import dense_ids, strict_lookup, value_counts
from sessionrec.operators.vectors import as_candidates, vector_topk
from sessionrec.sources.events import eligible_events
from sessionrec.sources.stages import materialize

GAMMA = 1e-10  # fixed value: keeps the loss finite


def item_ids(events: DataFrame) -> DataFrame:
    return dense_ids(events, "aid", "aid_idx")


def session_ids(events: DataFrame) -> DataFrame:
    return dense_ids(events, "session", "session_idx")


def lag_pairs(
    events: DataFrame, ids: DataFrame, count: int = 4, hot: DataFrame | None = None
) -> DataFrame:
    """Each event with the next ``count`` earlier events of its session."""
    indexed = strict_lookup(events, ids, "aid").select("session", "aid_idx", "ts", "eid")
    pairs = following(indexed, ["session"], newest_first(), ["aid_idx", "ts"], count, hot)
    return pairs.select("aid_idx", "next_aid_idx", (F.col("ts") - F.col("next_ts")).alias("ts_diff"))


def pair_coefs(pairs: DataFrame, events: DataFrame, ids: DataFrame) -> DataFrame:
    """Lag pairs with both coefficients: rarer items and shorter gaps count more."""
    sizes = value_counts(strict_lookup(events, ids, "aid"), "aid_idx")
    x = sizes.withColumnRenamed("counts", "_nx")
    y = sizes.select(F.col("aid_idx").alias("next_aid_idx"), F.col("counts").alias("_ny"))
    return (
        pairs.join(x, "aid_idx")
        .join(y, "next_aid_idx")
        .select(
            "aid_idx",
            "next_aid_idx",
            "ts_diff",
            (C.gap_damping(F.col("ts_diff")) / F.col("_nx")).alias("coef_x"),
            (1.0 / F.col("_ny")).alias("coef_y"),
        )
    )


def user_item_weights(train: DataFrame, test: DataFrame, min_events: int = 20) -> DataFrame:
    """Events of eligible sessions with the damped popularity of their item."""
    eligible = eligible_events(train, test, min_events).select("session", "aid")
    counts = value_counts(eligible, "aid")
    return eligible.join(counts, "aid").select(
        "session", "aid", (1.0 / F.log1p("counts")).alias("weight")
    )


def als(ratings: DataFrame, user: str, item: str, rank: int, iterations: int, seed: int = 77):
    """Implicit-feedback ALS; factors and solves are distributed over blocks."""
    blocks = max(10, ratings.sparkSession.sparkContext.defaultParallelism)
    return ALS(
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        userCol=user,
        itemCol=item,
        ratingCol="rating",
        implicitPrefs=True,
        rank=rank,
        maxIter=iterations,
        regParam=0.01,
        alpha=40.0,
        seed=seed,
        checkpointInterval=5,
    ).fit(ratings)


def item_factors(
    coefs: DataFrame, ids: DataFrame, rank: int = 256, iterations: int = 20, seed: int = 77
) -> DataFrame:
    """Item vectors from consecutive items: aid, vec. Pairs count in both directions."""
    rating = F.sum(F.col("coef_x") * F.col("coef_y")).alias("rating")
    one_way = coefs.groupBy("aid_idx", "next_aid_idx").agg(rating)
    other_way = one_way.select(
        F.col("next_aid_idx").alias("aid_idx"), F.col("aid_idx").alias("next_aid_idx"), "rating"
    )
    model = als(one_way.unionByName(other_way), "aid_idx", "next_aid_idx", rank, iterations, seed)
    return model.itemFactors.join(ids, F.col("id") == F.col("aid_idx")).select(
        "aid", F.col("features").alias("vec")
    )


def user_mf_candidates(
    train: DataFrame,
    test: DataFrame,
    rank: int = 256,
    iterations: int = 20,
    min_events: int = 20,
    k: int = 300,
    seed: int = 77,
) -> DataFrame:
    """Nearest items of each evaluated session by its own trained vector."""
    weights = materialize(user_item_weights(train, test, min_events), "user-item-weights")
    items, sessions = item_ids(weights), session_ids(weights)
    ratings = (
        weights.groupBy("session", "aid")
        .agg(F.sum("weight").alias("rating"))
        .join(items, "aid")
        .join(sessions, "session")
    )
    model = als(ratings, "session_idx", "aid_idx", rank, iterations, seed)
    queries = (
        model.userFactors.join(sessions, F.col("id") == F.col("session_idx"))
        .select("session", F.col("features").alias("vec"))
        .join(test.select("session").distinct(), "session", "left_semi")
    )
    vectors = model.itemFactors.join(items, F.col("id") == F.col("aid_idx")).select(
        "aid", F.col("features").alias("vec")
    )
    return as_candidates(vector_topk(queries, vectors, k), "user_mf")


def initial_vectors(ids: DataFrame, column: str, factors: int, seed: int) -> DataFrame:
    """Small uniform start vectors from a hash of the id, with empty Adam moments."""
    zero = F.array_repeat(F.lit(0.0), factors)
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(factors - 1)),
        lambda j: (F.pmod(F.xxhash64(F.col(column), j, F.lit(seed)), F.lit(1 << 20)) / float(1 << 19) - 1.0)
        / factors,
    )
    return ids.select(
        F.col(column).alias("id"), draw.alias("vec"), zero.alias("m"), zero.alias("v")
    )


def _batch_gradients(count: int, seed: int) -> Callable:
    """Gradient sums of one Arrow batch; negatives are the batch's own items permuted.

    A retried task may pair other negatives, every pairing is a valid draw. Workers
    need numpy and pandas but not this package.
    """

    def total(side: str, ids: np.ndarray, gradients: np.ndarray) -> pd.DataFrame:
        unique, place = np.unique(ids, return_inverse=True)
        summed = np.zeros((len(unique), gradients.shape[1]))
        np.add.at(summed, place, gradients)
        return pd.DataFrame({"side": side, "id": unique, "grad": list(summed), "loss": 0.0})

    def gradients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        for batch in batches:
            if batch.empty:
                continue
            x, y = np.stack(batch["vx"].to_numpy()), np.stack(batch["vy"].to_numpy())
            cx, cy = batch["coef_x"].to_numpy(), batch["coef_y"].to_numpy()
            other = rng.permutation(len(batch))
            yn, cn = y[other], cx * cy[other]
            cp = cx * cy
            margin = (x * y).sum(axis=1) * cp - (x * yn).sum(axis=1) * cn
            chance = 1.0 / (1.0 + np.exp(-margin))
            slope = (-chance * (1.0 - chance) / (GAMMA + chance) / count)[:, None]
            loss = -np.log(GAMMA + chance).sum() / count
            ids = batch["y"].to_numpy()
            left = total("x", batch["x"].to_numpy(), slope * (cp[:, None] * y - cn[:, None] * yn))
            right = total(
                "y",
                np.concatenate([ids, ids[other]]),
                np.concatenate([slope * cp[:, None] * x, -slope * cn[:, None] * x]),
            )
            left.loc[0, "loss"] = loss
            yield left
            yield right

    return gradients


def _adam(table: DataFrame, sums: DataFrame, step: int, lr: float, factors: int) -> DataFrame:
    """One Adam step of every vector; ids without gradient only decay."""
    b1, b2, eps = 0.9, 0.999, 1e-8
    zero = F.array_repeat(F.lit(0.0), factors)
    joined = table.join(sums, "id", "left").withColumn("grad", F.coalesce("grad", zero))
    moved = joined.select(
        "id",
        "vec",
        F.zip_with("m", "grad", lambda m, g: b1 * m + (1 - b1) * g).alias("m"),
        F.zip_with("v", "grad", lambda v, g: b2 * v + (1 - b2) * g * g).alias("v"),
    )
    scale1, scale2 = 1 - b1**step, 1 - b2**step
    change = F.zip_with(
        "m", "v", lambda m, v: lr * (m / scale1) / (F.sqrt(v / scale2) + eps)
    )
    return moved.select(
        "id", F.zip_with("vec", change, lambda w, c: w - c).alias("vec"), "m", "v"
    )


def bpr(
    examples: DataFrame,
    left: DataFrame,
    right: DataFrame | None,
    factors: int,
    epochs: int,
    lr: float,
    seed: int = 77,
    score: Callable[[DataFrame, DataFrame], float] | None = None,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Full-batch BPR. ``examples``: x, y, coef_x, coef_y; ``right`` None: shared vectors.

    Each epoch writes its vectors to the shared folder, which bounds lineage. The
    learning rate follows a cosine. With ``score`` the best epoch is kept, else the
    last. Returns vectors of both sides and the loss per epoch.
    """
    examples = materialize(examples, "examples")
    count = examples.count()
    shared = right is None
    tables = [left, left if shared else right]
    best, best_score, losses = tables, float("-inf"), []
    for epoch in range(epochs):
        x = tables[0].select(F.col("id").alias("x"), F.col("vec").alias("vx"))
        y = tables[1].select(F.col("id").alias("y"), F.col("vec").alias("vy"))
        batches = examples.join(x, "x").join(y, "y")
        parts = materialize(
            batches.mapInPandas(
                _batch_gradients(count, seed + epoch),
                "side string, id long, grad array<double>, loss double",
            ),
            "gradients",
        )
        losses.append(parts.agg(F.sum("loss")).first()[0])
        rate = lr * (1 + cos(pi * epoch / epochs)) / 2
        summed = Summarizer.sum(array_to_vector("grad"))

        def sums(rows: DataFrame) -> DataFrame:
            return rows.groupBy("id").agg(vector_to_array(summed).alias("grad"))

        if shared:
            new = materialize(_adam(tables[0], sums(parts), epoch + 1, rate, factors), "vectors")
            tables = [new, new]
        else:
            tables = [
                materialize(
                    _adam(t, sums(parts.filter(F.col("side") == s)), epoch + 1, rate, factors),
                    "vectors",
                )
                for t, s in zip(tables, ("x", "y"))
            ]
        if score is None:
            best = tables
        else:
            reached = score(*tables)
            if reached > best_score:
                best, best_score = tables, reached
    return best[0], best[1], losses


def item_examples(coefs: DataFrame) -> DataFrame:
    """Examples of consecutive items; their gap tells repeats of two items apart."""
    return coefs.select(
        F.col("aid_idx").alias("x"),
        F.col("next_aid_idx").alias("y"),
        F.col("ts_diff").alias("key"),
        "coef_x",
        "coef_y",
    )


def item_bpr(
    coefs: DataFrame,
    ids: DataFrame,
    factors: int = 256,
    epochs: int = 20,
    lr: float = 0.3,
    seed: int = 77,
    score: Callable[[DataFrame], float] | None = None,
    blocks: int | None = None,
    batch: int | None = 4096,
    folder: str | None = None,
) -> tuple[DataFrame, list[float]]:
    """Item vectors by BPR on consecutive items: aid, vec, and the loss per epoch.

    ``batch`` None: full-batch steps. ``folder``: a run that was lost goes on from there.
    """
    examples = item_examples(coefs)

    def named(table: DataFrame) -> DataFrame:
        return table.join(ids, F.col("id") == F.col("aid_idx")).select("aid", "vec")

    judge = None if score is None else lambda a, b: score(named(a))
    start = initial_vectors(ids, "aid_idx", factors, seed)
    if batch is None:
        table, _, losses = bpr(examples.drop("key"), start, None, factors, epochs, lr, seed, judge)
    else:
        table, _, losses = block_bpr(
            examples, start, None, epochs, lr, blocks, batch=batch, seed=seed, score=judge, folder=folder
        )
    return named(table), losses


def user_bpr(
    weights: DataFrame,
    items: DataFrame,
    sessions: DataFrame,
    factors: int = 256,
    epochs: int = 100,
    lr: float = 0.01,
    seed: int = 77,
    score: Callable[[DataFrame, DataFrame], float] | None = None,
    blocks: int | None = None,
    batch: int | None = 4096,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Session and item vectors by BPR: (session, vec), (aid, vec), loss per epoch.

    ``score`` judges the two tables after each epoch, and the best ones are kept. ``batch``
    None: full-batch steps. ``folder``: a run that was lost goes on from there.
    """
    examples = weights.join(items, "aid").join(sessions, "session").select(
        F.col("session_idx").alias("x"),
        F.col("aid_idx").alias("y"),
        F.lit(1.0).alias("coef_x"),
        F.col("weight").alias("coef_y"),
    )

    def named(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            left.join(sessions, F.col("id") == F.col("session_idx")).select("session", "vec"),
            right.join(items, F.col("id") == F.col("aid_idx")).select("aid", "vec"),
        )

    judge = None if score is None else lambda a, b: score(*named(a, b))
    users = initial_vectors(sessions, "session_idx", factors, seed)
    start = initial_vectors(items, "aid_idx", factors, seed + 1)
    if batch is None:
        left, right, losses = bpr(examples, users, start, factors, epochs, lr, seed, judge)
    else:
        keyed = examples.withColumn("key", F.lit(0))
        left, right, losses = block_bpr(
            keyed, users, start, epochs, lr, blocks, batch=batch, seed=seed, score=judge, folder=folder
        )
    return (*named(left, right), losses)


def pair_losses(coefs: DataFrame, items: DataFrame, ids: DataFrame) -> DataFrame:
    """BPR loss of given vectors: each pair against the item one id after its own."""
    size = ids.agg(F.count(F.lit(1))).scalar()
    vectors = items.join(ids, "aid").select("aid_idx", "vec")
    sizes = coefs.groupBy("next_aid_idx").agg(F.max("coef_y").alias("coef_n")).select(
        F.col("next_aid_idx").alias("neg_aid_idx"), "coef_n"
    )

    def side(column, name):
        return vectors.select(F.col("aid_idx").alias(column), F.col("vec").alias(name))

    scored = (
        coefs.withColumn("neg_aid_idx", F.pmod(F.col("next_aid_idx") + 1, size).cast("int"))
        .join(side("aid_idx", "vx"), "aid_idx")
        .join(side("next_aid_idx", "vy"), "next_aid_idx")
        .join(side("neg_aid_idx", "vn"), "neg_aid_idx")
        .join(sizes, "neg_aid_idx")
    )
    positive = C.dot(F.col("vx"), F.col("vy")) * F.col("coef_x") * F.col("coef_y")
    negative = C.dot(F.col("vx"), F.col("vn")) * F.col("coef_x") * F.col("coef_n")
    return scored.agg(
        F.avg(C.bpr_loss(positive, negative, GAMMA)).alias("loss"),
        F.count(F.lit(1)).alias("pairs"),
    )
