"""LambdaMART: boosted trees per session, by histograms, with an NDCG objective.

Features are cut into bins once, for the models of all folds. Whole sessions (bounded by the
generators' tops) lie side by side in blocks. Each round a task ranks the sessions of a block by
their current margins, forms the lambdas of relevant against other items inside the
session, and adds them up in histograms of (tree node, feature, bin). Only histograms are
shuffled; their size depends on features, bins and nodes and not on rows or pairs, and no pair
is ever a row of a table. Splits are chosen level by level, leaves are Newton steps.
``operators.boosting`` grows the trees.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.operators.blocks import block_reader, blocks, feature_array, feature_matrix, session_pairs
from sessionrec.operators.boosting import BINS, Objective, Tree, bin_cuts, boost, histograms, leaf_numbers, plain, searched
from sessionrec.operators.merge import N_FOLDS
from sessionrec.operators.rankers import NDCG_CUT, add_targets, with_target_rows
from sessionrec.sources.stages import read_stage, write_stage


@dataclass
class Model:
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    start_score: str | None = None
    ndcg: list[float] = field(default_factory=list)  # of the held-out sessions, by round


def _lambdas(cut: int):
    """Functions over rows of whole sessions: gradients and hessians, and the sessions' NDCG."""
    pairs, ndcg = session_pairs(cut)

    def lambdas(margins: np.ndarray, labels: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(labels), np.int64) if group is None else group
        a, b, worth = pairs(margins, labels, group)
        behind = 1.0 / (1.0 + np.exp(np.clip(margins[a] - margins[b], -50, 50)))
        pull = worth * behind
        curve = pull * (1.0 - behind)
        n = len(labels)
        gradient = np.bincount(b, pull, n) - np.bincount(a, pull, n)
        return gradient + 0.0, np.bincount(a, curve, n) + np.bincount(b, curve, n)  # no negative zero

    return lambdas, ndcg


def objective(learning_rate: float = 0.1, reg: float = 1.0, least: int = 20, cut: int = NDCG_CUT) -> Objective:
    """Lambdas of the sessions with a positive row, judged by their NDCG."""
    lambdas, ndcg = _lambdas(cut)

    def gradients(margins, labels, group, number):
        hit = np.bincount(group[labels > 0], minlength=int(group[-1]) + 1) if len(group) else group
        rows = np.flatnonzero(hit[group])
        return rows, *lambdas(margins[rows], labels[rows], group[rows])

    def metric(margins, labels, group):
        found = ndcg(margins, labels, group)
        return found.sum(), len(found)

    return Objective(gradients, metric, lambda number: learning_rate, reg, least)


def fit(
    rows: DataFrame,
    target: str,
    features: list[str],
    trees: int = 100,
    depth: int = 5,
    learning_rate: float = 0.1,
    start_score: str | None = None,
    validation: DataFrame | None = None,
    patience: int = 10,
    reg: float = 1.0,
    least: int = 20,
    bins: int = BINS,
    cuts: list[list[float]] | None = None,
) -> Model:
    """Boost until ``trees`` or, with ``validation`` rows, until NDCG stops rising."""
    part = rows.withColumn("_fold", F.lit(1))
    if validation is not None:
        part = part.unionByName(validation.withColumn("_fold", F.lit(0)))
    return _fit(
        part, rows, "_fold", [0], target, features, trees, depth, learning_rate, start_score, validation is not None, patience, reg, least, bins, cuts
    )[0]


def _fit(
    rows, cut_rows, fold, folds, target, features, trees=100, depth=5, learning_rate=0.1, start_score=None, validate=True, patience=10, reg=1.0, least=20, bins=BINS, cuts=None
) -> list[Model]:
    if not 0 < bins <= 256:
        raise ValueError("a bin is one byte")
    cuts = cuts or bin_cuts(cut_rows, features, bins)
    table = blocks(rows, target, features, F.col(fold), start_score, len(folds), cuts)
    grown = boost(table, cuts, folds, objective(learning_rate, reg, least), trees, depth, validate, patience)
    return [Model(list(features), cuts, g.trees, start_score, g.scores) for g in grown]


def predict(models: dict[int, Model], rows: DataFrame, by_fold: bool = True) -> DataFrame:
    """session, aid, fold, pred_score of all models in one scan of ``rows``.

    With ``by_fold`` a row is scored by the model of its own fold, else by every model.
    """
    _, values = leaf_numbers()
    grown = {k: (m.features, m.cuts, plain(m.trees), m.start_score) for k, m in models.items()}
    names = sorted({f for m in models.values() for f in (*m.features, *([m.start_score] if m.start_score else []))})
    matrix_of = feature_matrix(len(names))

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, matrix_of(batch["features"]).T.copy()))
            folds = batch["fold"].to_numpy(zero_copy_only=False)
            for fold, (features, cuts, trees, start) in grown.items():
                mine = np.flatnonzero(folds == fold) if by_fold else np.arange(len(folds))
                table = np.empty((len(features), len(mine)), np.uint8)
                for i, (name, cut) in enumerate(zip(features, cuts)):
                    own = columns[name][mine]
                    table[i] = np.searchsorted(np.array(cut), np.where(np.isnan(own), -np.inf, own), side="left")
                score = values(table, trees)
                if start:
                    score = score + np.nan_to_num(columns[start][mine])
                taken = pa.array(mine)
                arrays = [batch["session"].take(taken), batch["aid"].take(taken), pa.array(np.full(len(mine), fold, np.int32)), pa.array(score.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(arrays, ["session", "aid", "fold", "pred_score"])

    fold = F.col("fold").cast("int") if by_fold else F.lit(0)
    read = rows.select("session", "aid", fold.alias("fold"), feature_array(names).alias("features"))
    kinds = dict(read.dtypes)
    return read.mapInArrow(run, f"session {kinds['session']}, aid {kinds['aid']}, fold int, pred_score float")


def train_folds(
    sampled: DataFrame, target: str, features: list[str], folds: tuple[int, ...] = tuple(range(N_FOLDS)), **params
) -> dict[int, Model]:
    """One model per fold, trained on the other folds; boosting stops by the fold's NDCG.

    The models grow side by side on the same blocks. Their bins come from the features of all
    folds; no label is used for them.
    """
    rows = with_target_rows(add_targets(sampled), target)
    return dict(zip(folds, _fit(rows, rows, "fold", list(folds), target, features, **params)))


def predict_folds(models: dict[int, Model], pairs: DataFrame, target: str, by_fold: bool = True) -> DataFrame:
    """Scores as ``rankers.predict_folds`` gives them."""
    scored = predict(models, add_targets(pairs) if by_fold else pairs, by_fold)
    return scored.select(
        "session", "aid", F.lit("lambdamart").alias("model"), F.lit(target).alias("target"), "fold", "pred_score"
    )


def save(spark: SparkSession, model: Model, path: str) -> str:
    return write_stage(spark.createDataFrame([(repr(asdict(model)),)], "model string").coalesce(1), path)


def load(spark: SparkSession, path: str) -> Model:
    from ast import literal_eval

    found = literal_eval(read_stage(spark, path).first().model)
    return Model(**{**found, "trees": [Tree(**t) for t in found["trees"]]})


def gradients(rows: DataFrame, target: str, score: str, cut: int = NDCG_CUT) -> DataFrame:
    """session, aid, gradient, hessian of every row under the ranking by ``score``."""
    (lambdas, _), read = _lambdas(cut), block_reader(0, np.float32)

    def run(batches):
        for ids, _, labels, margins, _, group in read(batches):
            arrays = [pa.array(a) for a in (*ids, *lambdas(margins[0], labels, group))]
            yield pa.RecordBatch.from_arrays(arrays, ["session", "aid", "gradient", "hessian"])

    table = blocks(rows, target, [], F.lit(1), score)
    found = table.mapInArrow(run, "session long, aid long, gradient double, hessian double")
    return found.withColumns({c: F.col(c).cast(dict(rows.dtypes)[c]) for c in ("session", "aid")})


def root_splits(rows: DataFrame, target: str, cuts: dict[str, list[float]], score: str, reg: float = 1.0, least: int = 20) -> DataFrame:
    """feature, bin, n, g, h, gain of every cut of a first tree's root."""
    names, bounds, goal = list(cuts), list(cuts.values()), objective(reg=reg, least=least)
    cells, columns = max(map(len, bounds)) + 1, list(range(len(cuts)))
    table = blocks(rows, target, names, F.lit(1), score, cuts=bounds)
    sums = histograms(table, len(names), cells, [(0, 0, [], [], [], columns)], 0, 0, goal)
    found = searched(sums, cells, 0, {0: columns}, goal, every=True).filter("node = 0")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1)
    unit = F.lit(1.0 / goal.scale)
    return found.select(named.alias("feature"), "bin", "n", (F.col("g") * unit).alias("g"), (F.col("h") * unit).alias("h"), "gain")
