"""Skip-gram with negative sampling over distributed blocks of item vectors.

Pairs of items that stand near each other in a session are drawn from the events that follow
each event, so a session of any length is one sentence and nothing is lost at a border. Each
event reaches 1 to ``window`` events to both sides, by a hash of the event. For each pair,
``negatives`` items are drawn from the noise table: items in proportion to their number of
events to the power 0.75. A draw is a hash of its pair and meets its item by an equi-join on
cells of the noise range, so draws spread evenly however frequent an item is.

Pairs and draws are examples of two tables, input and output vectors, and are trained in the
strata of ``block_bpr``: cells of disjoint blocks side by side, slices of bounded size inside.
Neither the driver nor a task holds the vectors of the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionrec.functions.order import following, oldest_first
from sessionrec.operators.block_bpr import PARTS, block_bpr
from sessionrec.operators.factorization import initial_vectors
from sessionrec.sources.stages import materialize

NOISE_POWER = 0.75  # fixed value
_UNITS = 1024  # noise weights are whole numbers of this part of an event
_ITEMS = 4096  # items whose weights one window adds up


def _draw(*salted) -> Column:
    """A hash of the arguments as a number below 2^60."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *salted)), 1, 15), 16, 10).cast("bigint")


def context_pairs(events: DataFrame, window: int = 5, seed: int = 77, hot: DataFrame | None = None) -> DataFrame:
    """x, y, key: item, item in its context, and a key of the pair's place; one row per place."""
    rows = events.select("session", "aid", "ts", "eid")
    near = following(rows, ["session"], oldest_first(), ["aid", "eid"], window, hot)

    def reach(eid: str) -> Column:
        return _draw(F.col("session"), F.col(eid), F.lit(seed)) % F.lit(window) + 1

    def sided(x: str, y: str, centre: str, side: str) -> DataFrame:
        key = F.concat_ws(":", "session", "eid", "lag", F.lit(side))
        found = near.filter(F.col("lag") <= reach(centre))
        return found.select(F.col(x).alias("x"), F.col(y).alias("y"), key.alias("key"))

    return sided("aid", "next_aid", "eid", "after").union(sided("next_aid", "aid", "next_eid", "before"))


def noise_table(events: DataFrame) -> DataFrame:
    """aid, start, stop: each item's part of the noise range, in item order."""
    weight = F.greatest(F.lit(1), F.round(F.pow("c", F.lit(NOISE_POWER)) * _UNITS).cast("bigint"))
    counted = events.groupBy("aid").agg(F.count(F.lit(1)).alias("c")).select("aid", weight.alias("w"))
    counted = materialize(counted.withColumn("part", F.floor(F.col("aid") / _ITEMS)), "noise-weights")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per 4,096 ids of the catalogue.
    parts = counted.groupBy("part").agg(F.sum("w").alias("sum"))
    parts = parts.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("aid")
    stop = F.col("before") + F.col("upto")
    summed = counted.withColumn("upto", F.sum("w").over(inside)).join(parts, "part")
    return materialize(summed.select("aid", (stop - F.col("w")).alias("start"), stop.alias("stop")), "noise")


def negative_draws(pairs: DataFrame, noise: DataFrame, negatives: int = 5, seed: int = 77) -> DataFrame:
    """x, y: for each pair ``negatives`` items of the noise table; a pair's own item is no draw."""
    total, items = noise.agg(F.max("stop"), F.count(F.lit(1))).first()
    if not items:
        return pairs.select("x", "y").limit(0)
    width = -(-total // items)
    cells = noise.select(
        F.col("aid").alias("drawn"), "start", "stop",
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("cell"),
    )
    number = F.explode(F.sequence(F.lit(1), F.lit(negatives)))
    place = _draw(F.col("key"), F.col("number"), F.lit(seed)) % F.lit(total)
    draws = pairs.withColumn("number", number).withColumn("place", place)
    met = draws.withColumn("cell", F.floor(F.col("place") / width)).join(cells, "cell")
    met = met.filter("place >= start and place < stop and drawn != y")
    return met.select("x", F.col("drawn").alias("y"))


def _trainer(shared: bool, batch: int, lr: float, epoch: int) -> Callable:
    """One slice of two tables; ``coef_x`` is 1 for a pair and -1 for a draw."""
    names = [c.split()[0] for c in PARTS.split(", ")]
    b1, b2, eps = 0.9, 0.999, 1e-8

    def train(examples: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if examples.empty or members.empty:
            return pd.DataFrame(columns=names)
        examples = examples.sort_values(["draw", "x", "y", "coef_x"])
        members = members.sort_values(["side", "id"]).reset_index(drop=True)
        vec, m, v = (np.stack(members[c].to_numpy()).astype(float) for c in ("vec", "m", "v"))
        t = members["t"].to_numpy().copy()
        place = {}
        for side in ("x", "y"):
            rows = np.flatnonzero((members["side"] == side).to_numpy())
            place[side] = rows[np.searchsorted(members["id"].to_numpy()[rows], examples[side].to_numpy())]
        sign = examples["coef_x"].to_numpy()
        n = examples["n"].to_numpy().astype(float)
        loss = 0.0
        for start in range(0, len(examples), batch):
            s = slice(start, start + batch)
            px, py = place["x"][s], place["y"][s]
            margin = sign[s] * (vec[px] * vec[py]).sum(axis=1)
            loss += (n[s] * np.logaddexp(0.0, -margin)).sum()
            slope = (-sign[s] / (1.0 + np.exp(margin)) * n[s] / n[s].sum())[:, None]
            touched, at = np.unique(np.concatenate([px, py]), return_inverse=True)
            gradient = np.zeros((len(touched), vec.shape[1]))
            np.add.at(gradient, at, np.concatenate([slope * vec[py], slope * vec[px]]))
            t[touched] += 1
            m[touched] = b1 * m[touched] + (1 - b1) * gradient
            v[touched] = b2 * v[touched] + (1 - b2) * gradient * gradient
            age = t[touched][:, None]
            vec[touched] -= lr * (m[touched] / (1 - b1**age)) / (np.sqrt(v[touched] / (1 - b2**age)) + eps)
        rows = np.bincount(np.concatenate([place["x"], place["y"]]), minlength=len(members))
        out = members[["cell", "slice", "side", "id"]].assign(
            vec=list(vec), m=list(m), v=list(v), t=t, rows=rows, loss=0.0, weight=0.0
        )
        out.loc[0, ["loss", "weight"]] = loss, n.sum()
        return out[names]

    return train


def skip_gram(
    events: DataFrame,
    vector_size: int = 32,
    epochs: int = 10,
    lr: float = 0.01,
    window: int = 5,
    negatives: int = 5,
    seed: int = 77,
    hot: DataFrame | None = None,
    **strata,
) -> tuple[DataFrame, list[float]]:
    """aid, vec of every item of the log, and the loss per epoch.

    ``strata`` are the options of ``block_bpr``: blocks, slice_rows, batch, score, folder.
    """
    pairs = materialize(context_pairs(events, window, seed, hot), "context-pairs")
    draws = negative_draws(pairs, noise_table(events), negatives, seed)
    one = F.lit(1.0)
    examples = pairs.select("x", "y", F.lit(1).alias("key"), one.alias("coef_x"), one.alias("coef_y")).union(
        draws.select("x", "y", F.lit(0).alias("key"), -one, one)
    )
    items = events.select(F.col("aid").cast("long").alias("aid")).distinct()
    left = materialize(initial_vectors(items, "aid", vector_size, seed), "input-vectors")
    right = left.withColumn("vec", F.array_repeat(F.lit(0.0), vector_size))
    vectors, _, losses = block_bpr(examples, left, right, epochs, lr, seed=seed, trainer=_trainer, **strata)
    return vectors.select(F.col("id").cast("int").alias("aid"), F.col("vec").cast("array<float>").alias("vec")), losses
