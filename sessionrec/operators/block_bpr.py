"""BPR in strata: disjoint blocks of vectors, trained side by side in mini-batches.

Ids are dealt into ``blocks`` blocks by remainder. A round holds the examples whose two
blocks add up to its number (modulo ``blocks``). In a round every block meets exactly one
other, or itself, so its cells touch disjoint vectors, and all rounds together hold every
example once. This also holds when both sides share one table.

A cell beyond ``slice_rows`` examples is dealt into slices, as a hot id would otherwise keep
one task busy: each slice gets the vectors of its own ids only, and an id that several slices
moved takes their mean, weighted by examples. So a task's memory is bounded by ``slice_rows``,
whatever the catalogue and the keys. Repeated examples are one row with a weight.

Inside a slice the examples follow the order of a hash of the example, and the negative of
an example is the right side of another one of its slice, picked by that hash and the epoch.
Each mini-batch is one Adam step of the vectors it touches. Nothing depends on Arrow batches,
partition numbers or retries, so an epoch that is run again gives the same vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, cos, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.sources.stages import materialize, read_stage, stage_path, write_stage

GAMMA = 1e-10  # fixed value: keeps the loss finite
GRID = float(1 << 20)  # means are taken on this grid, where sums are exact in any order

PARTS = (
    "cell int, slice long, side string, id long, vec array<double>, m array<double>, "
    "v array<double>, t int, rows long, loss double, weight double"
)
SLICE = ["cell", "slice"]
KEYS = ["side", "id"]
STATE = ["side", "id", "vec", "m", "v", "t"]


@dataclass(frozen=True)
class Strata:
    """Examples dealt into rounds, cells and slices, and the ids that each slice needs."""

    examples: DataFrame
    members: DataFrame
    blocks: int
    weight: float


def deal(examples: DataFrame, shared: bool, blocks: int | None, slice_rows: int, seed: int = 77) -> Strata:
    """Strata of ``examples``: x, y, key, coef_x, coef_y.

    ``key`` tells apart examples of the same two ids. ``shared``: both sides are ids of one
    table. Without ``blocks`` there are as many, up to 64, as make the mean cell a slice.
    Written once to the shared folder, by round.
    """
    spark = examples.sparkSession
    unique = materialize(
        examples.groupBy("x", "y", "key", "coef_x", "coef_y").agg(F.count(F.lit(1)).alias("n")), "examples"
    )
    if blocks is None:
        blocks = min(64, max(1, ceil(sqrt(unique.count() / slice_rows))))
    if not 1 <= blocks <= 256:
        raise ValueError("blocks must be 1 to 256")
    left, right = F.pmod("x", F.lit(blocks)), F.pmod("y", F.lit(blocks))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "x", "y", "key", F.lit(seed))), 1, 13), 16, 10)
    dealt = unique.select(
        F.pmod(left + right, F.lit(blocks)).cast("int").alias("round"),
        (F.least(left, right) if shared else left).cast("int").alias("cell"),
        F.col("x").cast("long").alias("x"),
        F.col("y").cast("long").alias("y"),
        "coef_x",
        "coef_y",
        "n",
        draw.cast("long").alias("draw"),
    )
    slices = F.ceil(F.count(F.lit(1)) / slice_rows).alias("slices")
    # At most blocks x blocks rows.
    cells = F.broadcast(dealt.groupBy("round", "cell").agg(slices))
    sliced = dealt.join(cells, ["round", "cell"]).select(
        "round",
        "cell",
        F.pmod("draw", "slices").alias("slice"),
        "x",
        "y",
        "coef_x",
        "coef_y",
        "n",
        "draw",
        F.floor(F.col("draw") / F.col("slices")).alias("pick"),
    )
    path = write_stage(sliced, stage_path(spark, "strata"), ("round",))
    sliced = read_stage(spark, path, sliced.schema)
    names = [("x", "x"), ("x" if shared else "y", "y")]
    ids = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("id")) for side, c in names])
    members = (
        sliced.select("round", *SLICE, F.explode(ids).alias("member"))
        .select("round", *SLICE, "member.*")
        .distinct()
    )
    path = write_stage(members, stage_path(spark, "strata-members"), ("round",))
    total = sliced.agg(F.sum("n")).first()[0]
    return Strata(sliced, read_stage(spark, path, members.schema), blocks, float(total or 0))


def _trainer(shared: bool, batch: int, lr: float, epoch: int) -> Callable:
    """One slice: its examples and the vectors of its ids give the moved vectors."""
    gamma, right_side = GAMMA, "x" if shared else "y"
    b1, b2, eps = 0.9, 0.999, 1e-8
    names = [c.split()[0] for c in PARTS.split(", ")]

    def train(examples: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if examples.empty or members.empty:
            return pd.DataFrame(columns=names)
        examples = examples.sort_values(["draw", "x", "y", "coef_x", "coef_y"])
        members = members.sort_values(["side", "id"]).reset_index(drop=True)
        vec, m, v = (np.stack(members[c].to_numpy()).astype(float) for c in ("vec", "m", "v"))
        t = members["t"].to_numpy().copy()
        place = {}
        for column, side in (("x", "x"), ("y", right_side)):
            rows = np.flatnonzero((members["side"] == side).to_numpy())
            ids = members["id"].to_numpy()[rows]
            place[column] = rows[np.searchsorted(ids, examples[column].to_numpy())]
        cx, cy = examples["coef_x"].to_numpy(), examples["coef_y"].to_numpy()
        n = examples["n"].to_numpy().astype(float)
        other = (examples["pick"].to_numpy() + epoch * 1000003) % len(examples)
        loss = 0.0
        for start in range(0, len(examples), batch):
            s = slice(start, start + batch)
            px, py, pn = place["x"][s], place["y"][s], place["y"][other[s]]
            x, y, yn = vec[px], vec[py], vec[pn]
            cp, cn = cx[s] * cy[s], cx[s] * cy[other[s]]
            margin = (x * y).sum(axis=1) * cp - (x * yn).sum(axis=1) * cn
            chance = 1.0 / (1.0 + np.exp(-margin))
            loss -= (n[s] * np.log(gamma + chance)).sum()
            slope = (-chance * (1.0 - chance) / (gamma + chance) * n[s] / n[s].sum())[:, None]
            touched, at = np.unique(np.concatenate([px, py, pn]), return_inverse=True)
            gradient = np.zeros((len(touched), vec.shape[1]))
            np.add.at(
                gradient,
                at,
                np.concatenate(
                    [
                        slope * (cp[:, None] * y - cn[:, None] * yn),
                        slope * cp[:, None] * x,
                        -slope * cn[:, None] * x,
                    ]
                ),
            )
            t[touched] += 1
            m[touched] = b1 * m[touched] + (1 - b1) * gradient
            v[touched] = b2 * v[touched] + (1 - b2) * gradient * gradient
            age = t[touched][:, None]
            vec[touched] -= lr * (m[touched] / (1 - b1**age)) / (np.sqrt(v[touched] / (1 - b2**age)) + eps)
        rows = np.bincount(place["x"], minlength=len(members)) + np.bincount(place["y"], minlength=len(members))
        out = members[["cell", "slice", "side", "id"]].assign(
            vec=list(vec), m=list(m), v=list(v), t=t, rows=rows, loss=0.0, weight=0.0
        )
        out.loc[0, ["loss", "weight"]] = loss, n.sum()
        return out[names]

    return train


def run_round(
    strata: Strata, number: int, state: DataFrame, shared: bool, batch: int, lr: float, epoch: int = 0,
    trainer: Callable = _trainer,
) -> DataFrame:
    """Moved vectors of one round by slice; a slice's first row has its loss and weight."""
    here = F.col("round") == number
    members = strata.members.filter(here).drop("round").join(state, KEYS)
    examples = strata.examples.filter(here).drop("round")
    step = trainer(shared, batch, lr, epoch)
    return examples.groupBy(*SLICE).cogroup(members.groupBy(*SLICE)).applyInPandas(step, PARTS)


def merged(state: DataFrame, parts: DataFrame) -> DataFrame:
    """The state after a round.

    An id moved by one slice takes its vector. Of several, the vector is their mean weighted
    by examples, and the moments are those of the slice with the most examples.
    """
    moved = F.struct("vec", "m", "v", "t")
    scaled = F.transform("vec", lambda w: F.round(w * GRID) * F.col("rows"))
    found = parts.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("slices"),
        F.sum("rows").alias("row_sum"),
        vector_to_array(Summarizer.sum(array_to_vector(scaled))).alias("total"),
        F.max_by(moved, F.struct("rows", F.col("slice"))).alias("main"),
    )
    mean = F.transform("total", lambda w: w / GRID / F.col("row_sum"))
    found = found.select(
        *KEYS, F.when(F.col("slices") == 1, F.col("main.vec")).otherwise(mean).alias("new"), "main"
    )
    return state.join(found, KEYS, "left").select(
        *KEYS,
        F.coalesce("new", "vec").alias("vec"),
        *[F.coalesce(F.col("main")[c], F.col(c)).alias(c) for c in ("m", "v", "t")],
    )


def _finished(spark: SparkSession, folder: str) -> list[tuple[float, float | None]]:
    """(loss, score) of the epochs that a former run completed, one row each."""
    try:
        rows = spark.read.parquet(f"{folder}/manifest").orderBy("epoch").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [(r["loss"], r["score"]) for r in rows]


def block_bpr(
    examples: DataFrame,
    left: DataFrame,
    right: DataFrame | None,
    epochs: int,
    lr: float,
    blocks: int | None = None,
    slice_rows: int = 100_000,
    batch: int = 4096,
    seed: int = 77,
    score: Callable[[DataFrame, DataFrame], float] | None = None,
    folder: str | None = None,
    trainer: Callable = _trainer,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Vectors (id, vec) of both sides and the loss per epoch; ``right`` None: one table.

    ``left`` and ``right``: id, vec, m, v. ``score`` judges the vectors after each epoch, and
    the best epoch is kept, else the last. ``trainer`` moves the vectors of a slice. With ``folder``, each epoch's state is written there
    and then listed in a manifest; a run with the same arguments goes on after the last listed
    epoch.
    """
    spark = examples.sparkSession
    shared = right is None
    sides = [("x", left)] + ([] if shared else [("y", right)])
    state = None
    for side, table in sides:
        rows = table.select(F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), "vec", "m", "v")
        rows = rows.withColumn("t", F.lit(0))
        state = rows if state is None else state.unionByName(rows)

    def views(table: DataFrame) -> tuple[DataFrame, DataFrame]:
        first = table.filter(F.col("side") == "x").select("id", "vec")
        return first, first if shared else table.filter(F.col("side") == "y").select("id", "vec")

    strata = deal(examples, shared, blocks, slice_rows, seed)
    schema = state.schema
    home = folder or stage_path(spark, "bpr")
    done = _finished(spark, home) if folder else []
    if done:
        state = read_stage(spark, f"{home}/epoch-{len(done) - 1}", schema)
    else:
        state = materialize(state, "vectors")
    for epoch in range(len(done), epochs):
        rate = lr * (1 + cos(pi * epoch / epochs)) / 2
        total = 0.0
        for number in range(strata.blocks):
            parts = materialize(run_round(strata, number, state, shared, batch, rate, epoch, trainer), "round")
            total += float(parts.agg(F.sum(F.col("loss").cast("decimal(38,9)"))).first()[0] or 0)
            state = merged(state, parts)
            if number < strata.blocks - 1:
                state = materialize(state, "vectors")
        path = write_stage(state, f"{home}/epoch-{epoch}")
        state = read_stage(spark, path, schema)
        done.append((total / max(strata.weight, 1.0), None if score is None else float(score(*views(state)))))
        if folder:
            line = spark.createDataFrame([(epoch, *done[-1])], "epoch int, loss double, score double")
            line.coalesce(1).write.mode("append").parquet(f"{home}/manifest")
    kept = len(done) - 1
    if score is not None and done:
        kept = max(range(len(done)), key=lambda e: (done[e][1], -e))
    if kept >= 0:
        state = read_stage(spark, f"{home}/epoch-{kept}", schema)
    return (*views(state), [loss for loss, _ in done])


def stratum_losses(
    examples: DataFrame, vectors: DataFrame, blocks: int, slice_rows: int, seed: int = 77
) -> DataFrame:
    """Loss and gradient sum of every slice at given item vectors (id, vec), both sides shared.

    round, cell, slice, weight, loss (mean) and gradient (sum over ids and places, of the
    mean loss): one step of each slice as training takes it, without moving vectors.
    """
    strata = deal(examples, True, blocks, slice_rows, seed)
    zero = F.transform("vec", lambda w: F.lit(0.0))
    state = vectors.select(
        F.lit("x").alias("side"), F.col("id").cast("long").alias("id"),
        F.transform("vec", lambda w: w.cast("double")).alias("vec"), zero.alias("m"), zero.alias("v"), F.lit(0).alias("t"),
    )
    state = materialize(state, "vectors")
    found = None
    for number in range(blocks):
        # A batch as large as the slice; Adam's first moment from zero is a tenth of the gradient.
        parts = run_round(strata, number, state, True, slice_rows * 4, 0.0)
        moved = F.aggregate("m", F.lit(0.0), lambda a, w: a + w) * 10
        rows = parts.groupBy(*SLICE).agg(
            F.sum("weight").cast("long").alias("weight"),
            (F.sum("loss") / F.sum("weight")).alias("loss"),
            F.sum(moved).alias("gradient"),
        )
        rows = rows.select(F.lit(number).alias("round"), "*")
        found = rows if found is None else found.unionByName(rows)
    return found
