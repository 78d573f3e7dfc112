"""Fitted rankers order candidates better than the vote score they start from."""

import random

import pytest

from sessionrec.operators import evaluation as ev
from sessionrec.operators import rankers as rk

FEATURES = ["vote", "signal", "noise"]


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(4)
    rows = []
    for session in range(90):
        for aid in range(12):
            signal, vote = rnd.random(), rnd.random()
            click = int(signal + 0.2 * rnd.random() > 0.95)
            rows.append((session, aid, vote, signal, rnd.random(), click, 0, 0, 0, 1, 1, session % 3))
    columns = "session int, aid int, vote double, signal double, noise double, target_click tinyint, " \
        "target_cart tinyint, target_order tinyint, no_target_click tinyint, no_target_cart tinyint, " \
        "no_target_order tinyint, fold tinyint"
    return spark.createDataFrame(rows, columns)


def ndcg(scored, score):
    return ev.ndcg_at_k(scored, "target_click", 20, score).first().ndcg


@pytest.mark.parametrize(
    "kind,params", [("pointwise", {"trees": 8, "depth": 3}), ("pairwise", {"rounds": 1, "start_score": "vote"})]
)
def test_out_of_fold_ndcg_beats_the_vote(pairs, kind, params):
    models = rk.train_folds(pairs, "target_click", FEATURES, kind=kind, **params)
    scores = rk.predict_folds(models, pairs, "target_click", FEATURES, kind)
    assert scores.count() == pairs.count()
    scored = pairs.join(scores.select("session", "aid", "pred_score"), ["session", "aid"])
    assert ndcg(scored, "pred_score") > ndcg(pairs, "vote") + 0.2


def test_trees_stop_early(pairs):
    rows = rk.training_rows(pairs, "target_click", 0)
    options = {"trees": 30, "depth": 2, "learning_rate": 1.0}
    whole = rk.fit_pointwise(rows, "target_click", FEATURES, **options)
    held_out = rk.validation_rows(pairs, "target_click", 0)
    early = rk.fit_pointwise(rows, "target_click", FEATURES, **options, validation=held_out)
    assert early.stages[-1].getNumTrees < whole.stages[-1].getNumTrees == 30
    none = rk.fit_pointwise(rows, "target_click", FEATURES, trees=2, validation=held_out.limit(0))
    assert none.stages[-1].getNumTrees == 2


def test_linear_loss_and_gradient_are_those_of_the_pairs(spark, pairs):
    """Summed by blocks they equal the sums over ``pairwise_examples``, and no pair is stored."""
    import numpy as np
    from pyspark.sql import functions as F

    from sessionrec.operators import linear
    from sessionrec.operators.blocks import blocks

    rows = rk.training_rows(pairs, "target_click", 1)
    found = rk.pairwise_examples(rows, "target_click", FEATURES, "vote").collect()
    diff, weight = np.array([r["diff"] for r in found]), np.array([r.weight for r in found])
    point = np.array([0.3, 2.0, -0.7])
    ahead = diff @ point
    table = blocks(rk.with_target_rows(pairs, "target_click"), "target_click", FEATURES, F.col("fold"), "vote", block_rows=50)
    got = linear.pair_sums(table, 3, [(0, 1, None, point)], True, 20)[0]
    assert np.allclose(got[0], weight.sum()) and np.allclose(got[1], (weight * np.logaddexp(0, -ahead)).sum())
    assert np.allclose(got[2:], -(diff * (weight / (1 + np.exp(ahead)))[:, None]).sum(axis=0), atol=1e-4)
    squares = linear.pair_sums(table, 3, [(0, 1, None, None)], True, 20)[0]
    assert np.allclose(squares[2:], (diff**2 * weight[:, None]).sum(axis=0), rtol=1e-4)


def test_boosting_goes_on_while_the_error_falls(pairs):
    """Small steps each lower the error by under a hundredth, and still go on."""
    rows, held_out = rk.training_rows(pairs, "target_click", 0), rk.validation_rows(pairs, "target_click", 0)
    model = rk.fit_pointwise(rows, "target_click", FEATURES, trees=12, depth=2, learning_rate=0.02, validation=held_out)
    assert model.stages[-1].getNumTrees > 5


def test_rank_pointwise_keeps_the_rankers_size(spark, sf, monkeypatch):
    """The query sets no smaller number of trees or depth than the ranker's own."""
    from sessionrec.plans import queries as q

    given = {}
    monkeypatch.setattr(q, "_merged", lambda _: spark.sql("select 1 session, 1 aid, 0 fold, 0 x, 0 target_click, 0 target_cart, 0 target_order"))
    monkeypatch.setattr(q.rk, "train_folds", lambda *a, **k: given.update(k) or {})
    monkeypatch.setattr(q.rk, "predict_folds", lambda *a, **k: None)
    q.queries()["rank_pointwise"](spark, sf)
    assert given == {"kind": "pointwise"}
