"""Training sets, rankers and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionrec.functions.order import best_first
from sessionrec.operators.blocks import blocks, feature_array
from sessionrec.operators.boosting import Grown, Objective, bin_cuts, boost
from sessionrec.operators.linear import minimised
from sessionrec.operators.merge import N_FOLDS
from sessionrec.sources.stages import materialize, write_stage

# Targets in training order, weight of a positive row per target,
# targets of the pairwise ranker, cut-off of its metric.
TARGETS = ("target_inter", "target_buy", "target_click", "target_cart", "target_order")
PAIRWISE_TARGETS = ("target_buy", "target_cart", "target_order")
POSITIVE_WEIGHT = {"target_click": 100.0}
OTHER_POSITIVE_WEIGHT = 200.0
NDCG_CUT = 20


def add_targets(pairs: DataFrame) -> DataFrame:
    """target_inter (any) and target_buy (cart or order)."""
    buy = F.greatest("target_cart", "target_order")
    return pairs.withColumns(
        {"target_inter": F.greatest("target_click", buy), "target_buy": buy}
    )


def with_target_rows(pairs: DataFrame, target: str, session_level: bool = False) -> DataFrame:
    """Rows that take part in training a target.

    Sessions without a positive of the target are left out; target_inter keeps all.
    For target_buy the published filter keeps, of sessions without a cart, only the
    ordered rows; ``session_level`` keeps whole sessions with an order.
    """
    if target == "target_inter":
        return pairs
    if target == "target_buy":
        order = F.col("no_target_order") == 0 if session_level else F.col("target_order") == 1
        return pairs.filter((F.col("no_target_cart") == 0) | order)
    return pairs.filter(F.col(f"no_{target}") == 0)


def training_rows(sampled: DataFrame, target: str, fold: int) -> DataFrame:
    """Training rows of a fold: those of the other folds."""
    return with_target_rows(add_targets(sampled), target).filter(F.col("fold") != fold)


def validation_rows(pairs: DataFrame, target: str, fold: int) -> DataFrame:
    """Validation rows of a fold, from the sampled or from the full table."""
    return with_target_rows(add_targets(pairs), target).filter(F.col("fold") == fold)


def positive_weight(target: str):
    scale = POSITIVE_WEIGHT.get(target, OTHER_POSITIVE_WEIGHT)
    return F.when(F.col(target) == 1, F.lit(scale)).otherwise(F.lit(1.0))


def _logistic(weight: float, learning_rate: float, seed: int) -> Objective:
    """Logistic loss of single rows, positives weighted up; the first tree fits the labels."""

    def signed(labels):
        return np.where(labels > 0, 1.0, -1.0), np.where(labels > 0, weight, 1.0)

    def gradients(margins, labels, group, number):
        sign, worth = signed(labels)
        left = sign if number == 0 else 4.0 * sign / (1.0 + np.exp(np.clip(2.0 * sign * margins, -50, 50)))
        return np.arange(len(labels)), -worth * left, worth

    def metric(margins, labels, group):
        sign, worth = signed(labels)
        return -2.0 * (worth * np.logaddexp(0.0, -2.0 * sign * margins)).sum(), int(worth.sum())

    return Objective(
        gradients, metric, lambda number: learning_rate if number else 1.0,
        reg=0.0, least=1, scale=1 << 20, rows=0.9, features=0.5, seed=seed, fewest=1,
    )


def fit_pointwise(
    rows: DataFrame,
    target: str,
    features: list[str],
    trees: int = 100,
    depth: int = 5,
    learning_rate: float = 0.05,
    seed: int = 77,
    validation: DataFrame | None = None,
    patience: int = 10,
) -> PipelineModel:
    """Gradient-boosted trees on single rows, positives weighted up.

    With ``validation`` rows, boosting stops when their error has not fallen for ``patience``
    trees, and the trees up to the smallest error stay. A tree is grown on 0.9 of the rows and
    half of the features.
    """
    part, held_out = rows.withColumn("_fold", F.lit(1)), validation is not None and not validation.isEmpty()
    if held_out:
        part = part.unionByName(validation.withColumn("_fold", F.lit(0)))
    return _fit_pointwise(part, rows, "_fold", [0], target, features, trees, depth, learning_rate, seed, held_out, patience)[0]


def _fit_pointwise(
    rows, cut_rows, fold, folds, target, features, trees=100, depth=5, learning_rate=0.05, seed=77, validate=True, patience=10
) -> list[PipelineModel]:
    """A model for each fold of ``folds``, grown side by side on the rows of the others."""
    goal = _logistic(POSITIVE_WEIGHT.get(target, OTHER_POSITIVE_WEIGHT), learning_rate, seed)
    cuts = bin_cuts(cut_rows, features)
    table = blocks(rows, target, features, F.col(fold), None, len(folds), cuts)
    grown = boost(table, cuts, folds, goal, trees, depth, validate, patience)
    return [_as_pipeline(rows.sparkSession, g, cuts, features, goal) for g in grown]


def _doubles(spark: SparkSession, values):
    array = spark.sparkContext._gateway.new_array(spark._jvm.double, len(values))
    for i, value in enumerate(values):
        array[i] = float(value)
    return array


def _as_pipeline(spark: SparkSession, grown: Grown, cuts: list[list[float]], features: list[str], goal: Objective) -> PipelineModel:
    """The grown trees as a fitted pipeline of Spark ML. Impurities are not kept: they are 0."""
    ml, mllib = spark._jvm.org.apache.spark.ml, spark._jvm.org.apache.spark.mllib

    def node(seen: dict, level: int, number: int):
        feature, cut, gain, g, h, n = seen.get((level, number), (-1, 0, 0.0, 0.0, 0.0, 0))
        value = -g / h if h else 0.0
        stats = mllib.tree.impurity.VarianceCalculator(_doubles(spark, [h, -g, -g * value]), int(n))
        if feature < 0:
            return ml.tree.LeafNode(value, 0.0, stats)
        split = ml.tree.ContinuousSplit(feature, float(cuts[feature][cut]))
        sides = (node(seen, level + 1, 2 * number + side) for side in (0, 1))
        return ml.tree.InternalNode(value, 0.0, gain / h, *sides, split, stats)

    kind = ml.regression.DecisionTreeRegressionModel
    trees = spark.sparkContext._gateway.new_array(kind, len(grown.nodes))
    for i, seen in enumerate(grown.nodes):
        trees[i] = kind(f"boosted-tree-{i}", node(seen, 0, 0), len(features))
    weights = _doubles(spark, [goal.rate(i) for i in range(len(grown.nodes))])
    model = ml.classification.GBTClassificationModel("boosted-trees", trees, weights, len(features), 2)
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features"), GBTClassificationModel(model)])


def predict_pointwise(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """session, aid, pred_score = probability of a positive."""
    scored = model.transform(rows)
    return scored.select(
        "session", "aid", vector_to_array("probability")[1].cast("float").alias("pred_score")
    )


def pairwise_examples(
    rows: DataFrame, target: str, features: list[str], score: str | None = None
) -> DataFrame:
    """Positive against negative rows of a session: feature differences.

    Rows are merged candidates: a session has at most the sum of all generators'
    ``top`` of them, which bounds its pairs. With ``score`` each example is weighted
    by how much swapping the two rows in the current ranking changes NDCG.
    """
    base = rows.select(
        "session", "aid", F.col(target).alias("_t"), feature_array(features).alias("_f"),
        *([F.col(score).alias("_s")] if score else []),
    )
    if score:
        ranking = Window.partitionBy("session").orderBy(*best_first("_s"))
        whole = Window.partitionBy("session")
        place = F.row_number().over(ranking)
        base = base.withColumn("_p", place).withColumn("_n", F.sum("_t").over(whole))
        base = base.withColumn(
            "_d", F.when(F.col("_p") <= NDCG_CUT, 1.0 / F.log2(F.col("_p") + 1.0)).otherwise(0.0)
        )
    positive = base.filter("_t = 1").alias("p")
    negative = base.filter("_t = 0").alias("n")
    joined = positive.join(negative, F.col("p.session") == F.col("n.session"))
    weight = F.lit(1.0)
    if score:
        ideal = F.aggregate(
            F.sequence(F.lit(1), F.least(F.col("p._n"), F.lit(NDCG_CUT)).cast("int")),
            F.lit(0.0),
            lambda s, r: s + 1.0 / F.log2(r.cast("double") + 1.0),
        )
        weight = F.abs(F.col("p._d") - F.col("n._d")) / ideal
    return joined.select(
        F.col("p.session").alias("session"),
        F.col("p.aid").alias("pos_aid"),
        F.col("n.aid").alias("neg_aid"),
        weight.alias("weight"),
        F.zip_with("p._f", "n._f", lambda a, b: a - b).alias("diff"),
    )


def fit_pairwise(
    rows: DataFrame,
    target: str,
    features: list[str],
    rounds: int = 2,
    start_score: str | None = None,
    iterations: int = 50,
) -> Model:
    """Linear LambdaRank: logistic regression on feature differences (``pairwise_examples``).

    Each round reweights the pairs by the NDCG change under the ranking of the round
    before (``start_score`` ranks the first; without one the first round's pairs weigh the same).
    A pair counts in both directions, and is formed inside its session's block, so that losses
    and gradients are summed and no pair is a row of a table.
    """
    return _fit_pairwise(rows.withColumn("_fold", F.lit(1)), "_fold", [0], target, features, rounds, start_score, iterations)[0]


def _fit_pairwise(rows, fold, folds, target, features, rounds=2, start_score=None, iterations=50) -> list[Model]:
    """A model for each fold of ``folds``, fitted side by side to the rows of the others."""
    spark = rows.sparkSession
    table = materialize(blocks(rows, target, features, F.col(fold), start_score), "pair-blocks")
    found = minimised(table, len(features), folds, max(1, rounds), iterations, start_score is not None, NDCG_CUT)
    ml, models = spark._jvm.org.apache.spark.ml, []
    for coefficients in found:
        vector = ml.linalg.DenseVector(_doubles(spark, coefficients))
        models.append(LogisticRegressionModel(ml.classification.LogisticRegressionModel("linear-ranker", vector, 0.0)))
    return models


def _with_margin(model: Model, rows: DataFrame, features: list[str]) -> DataFrame:
    vectored = rows.withColumn("features", array_to_vector(feature_array(features)))
    scored = model.transform(vectored)
    margin = vector_to_array("rawPrediction")[1]
    return scored.withColumn("_margin", margin).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def predict_pairwise(model: Model, rows: DataFrame, features: list[str]) -> DataFrame:
    """session, aid, pred_score = margin of the linear ranker."""
    return _with_margin(model, rows, features).select(
        "session", "aid", F.col("_margin").cast("float").alias("pred_score")
    )


def load_model(path: str, kind: str) -> Model:
    """A fold's model as ``train_folds`` returned it and as its writer saved it."""
    return {"pointwise": PipelineModel, "pairwise": LogisticRegressionModel}[kind].load(path)


def train_folds(
    sampled: DataFrame,
    target: str,
    features: list[str],
    folds: tuple[int, ...] = tuple(range(N_FOLDS)),
    kind: str = "pointwise",
    **params,
) -> dict[int, Model]:
    """One model per fold, trained on the other folds; trees stop early by the fold's rows.

    The models of all folds share each pass over the blocks of rows.
    """
    rows = with_target_rows(add_targets(sampled), target)
    if kind == "pointwise":
        models = _fit_pointwise(rows, rows, "fold", list(folds), target, features, **params)
    else:
        models = _fit_pairwise(rows, "fold", list(folds), target, features, **params)
    return dict(zip(folds, models))


def predict_folds(
    models: dict[int, Model],
    pairs: DataFrame,
    target: str,
    features: list[str],
    kind: str = "pointwise",
    by_fold: bool = True,
) -> DataFrame:
    """Scores of a kind and target: session, aid, model, target, fold, pred_score.

    Labelled data are scored out of fold; without folds (submission) every model
    scores every row.
    """
    parts = None
    for fold, model in models.items():
        rows = add_targets(pairs) if by_fold else pairs
        if by_fold:
            rows = rows.filter(F.col("fold") == fold)
        scored = (
            predict_pointwise(model, rows)
            if kind == "pointwise"
            else predict_pairwise(model, rows, features)
        )
        part = scored.select(
            "session",
            "aid",
            F.lit(kind).alias("model"),
            F.lit(target).alias("target"),
            F.lit(fold).alias("fold"),
            "pred_score",
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def write_scores(scores: DataFrame, path: str) -> str:
    """Prediction sink, one folder per model, target and fold."""
    return write_stage(scores, path, ("model", "target", "fold"))


def feature_importance(
    spark: SparkSession, models: dict[int, PipelineModel], features: list[str], top: int = 200
) -> DataFrame:
    """Importance of each feature summed over the folds, highest first."""
    rows = [
        (name, float(value))
        for model in models.values()
        for name, value in zip(features, model.stages[-1].featureImportances.toArray())
    ]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return (
        table.groupBy("feature")
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
        .limit(top)
    )
