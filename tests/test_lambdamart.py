"""Boosted rankers against brute force, the linear ranker and the vote."""

import numpy as np
import pytest
from test_rankers import FEATURES, ndcg, pairs  # noqa: F401

from sessionrec.operators import lambdamart as lm
from sessionrec.operators import rankers as rk


def brute(margins, labels, cut=20):
    order = sorted(range(len(margins)), key=lambda i: (-margins[i], i))
    place = {i: p + 1 for p, i in enumerate(order)}
    discount = [1 / np.log2(place[i] + 1) if place[i] <= cut else 0.0 for i in range(len(margins))]
    ideal = sum(1 / np.log2(p + 1) for p in range(1, min(sum(labels), cut) + 1))
    g, h = [0.0] * len(labels), [0.0] * len(labels)
    for i in range(len(labels)):
        for j in range(len(labels)):
            if labels[i] and not labels[j]:
                rho = 1 / (1 + np.exp(margins[i] - margins[j]))
                worth = abs(discount[i] - discount[j]) / ideal
                g[i] -= worth * rho
                g[j] += worth * rho
                h[i] += worth * rho * (1 - rho)
                h[j] += worth * rho * (1 - rho)
    return g, h


def test_lambdas_against_pairs():
    rng = np.random.default_rng(5)
    lambdas, _ = lm._lambdas(20)
    for n in (1, 2, 7, 40):
        margins, labels = np.round(rng.normal(size=n), 1), (rng.random(n) > 0.7).astype(int)
        got = lambdas(margins, labels)
        if labels.any():
            assert np.allclose(got, brute(margins.tolist(), labels.tolist()))
    assert not np.any(lambdas(np.zeros(3), np.zeros(3)))


@pytest.fixture(scope="module")
def models(pairs):  # noqa: F811
    return lm.train_folds(pairs, "target_click", FEATURES, trees=12, depth=3, learning_rate=0.3, patience=4, least=5)


def test_out_of_fold_ndcg_beats_linear_and_vote(pairs, models):  # noqa: F811
    scores = lm.predict_folds(models, pairs, "target_click")
    assert scores.count() == pairs.count()
    scored = pairs.join(scores.select("session", "aid", "pred_score"), ["session", "aid"])
    linear = rk.train_folds(pairs, "target_click", FEATURES, kind="pairwise", rounds=1, start_score="vote")
    other = rk.predict_folds(linear, pairs, "target_click", FEATURES, "pairwise")
    plain = pairs.join(other.select("session", "aid", "pred_score"), ["session", "aid"])
    assert ndcg(scored, "pred_score") >= ndcg(plain, "pred_score") - 0.02
    assert ndcg(scored, "pred_score") > ndcg(pairs, "vote") + 0.2


def test_a_rule_that_no_line_ranks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(120):
        for a in range(12):
            x = float(rng.random())
            rows.append((s, a, x, float(rng.random()), int(0.45 < x < 0.55), 0, 0, 1, 1, 1, s % 3))
    names = "session int, aid int, x double, noise double, target_click tinyint, target_cart tinyint, " \
        "target_order tinyint, no_target_click tinyint, no_target_cart tinyint, no_target_order tinyint, fold tinyint"
    rows = [(*r[:7], int(not any(q[4] for q in rows[r[0] * 12 : r[0] * 12 + 12])), 1, 1, r[10]) for r in rows]
    table = spark.createDataFrame(rows, names)
    model = lm.train_folds(table, "target_click", ["x", "noise"], folds=(0,), trees=10, depth=3, learning_rate=0.5, least=5)
    held = table.filter("fold = 0")
    scored = held.join(lm.predict(model, held).select("session", "aid", "pred_score"), ["session", "aid"])
    linear = rk.train_folds(table, "target_click", ["x", "noise"], folds=(0,), kind="pairwise", rounds=1)
    plain = held.join(rk.predict_pairwise(linear[0], held, ["x", "noise"]), ["session", "aid"])
    assert ndcg(scored, "pred_score") > ndcg(plain, "pred_score") + 0.2


def test_trees_do_not_depend_on_partitions(pairs):  # noqa: F811
    options = {"trees": 3, "depth": 2, "least": 5}
    one = lm.fit(pairs.coalesce(1), "target_click", FEATURES, cuts=[[0.2, 0.5, 0.8]] * 3, **options)
    many = lm.fit(pairs.repartition(7), "target_click", FEATURES, cuts=[[0.2, 0.5, 0.8]] * 3, **options)
    assert one.trees == many.trees and len(one.trees) == 3


def test_stops_early_and_saves(spark, pairs, models, tmp_path):  # noqa: F811
    for model in models.values():
        assert len(model.trees) == int(np.argmax(model.ndcg))
    again = {k: lm.load(spark, lm.save(spark, m, str(tmp_path / str(k)))) for k, m in models.items()}
    assert again == models
    before, after = (sorted(lm.predict(m, pairs).collect()) for m in (models, again))
    assert before == after
    plan = lm.predict(models, pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # all folds in one scan


def test_nulls_and_empty(spark, pairs):  # noqa: F811
    from pyspark.sql import functions as F

    holes = pairs.withColumn("noise", F.when(F.col("aid") > 3, F.col("noise")))
    model = lm.fit(holes, "target_click", FEATURES, trees=1, depth=2, least=5)
    assert lm.predict({0: model}, holes, by_fold=False).count() == pairs.count()
    empty = lm.fit(pairs.limit(0), "target_click", FEATURES, trees=2, depth=2)
    assert all(v == 0.0 for t in empty.trees for v in t.leaves)


def test_lambdas_of_many_sessions_at_once():
    """A block holds many sessions; their lambdas are those of each session alone."""
    rng = np.random.default_rng(8)
    lambdas, ndcg = lm._lambdas(20)
    sizes = rng.integers(1, 40, 30)
    group = np.repeat(np.arange(30) * 2, sizes)  # numbers may have gaps
    margins, labels = np.round(rng.normal(size=len(group)), 1), (rng.random(len(group)) > 0.8).astype(int)
    got = lambdas(margins, labels, group)
    for s in range(30):
        own = group == 2 * s
        if labels[own].any():
            assert np.allclose([g[own] for g in got], brute(margins[own].tolist(), labels[own].tolist()))
    assert len(ndcg(margins, labels, group)) == len(set(group[labels > 0]))


def test_all_folds_share_the_passes(spark, pairs, monkeypatch):  # noqa: F811
    """One scan of the blocks serves the models of all folds, so passes do not grow with them."""
    from sessionrec.operators import boosting as bo

    passes = []
    whole = bo.histograms
    monkeypatch.setattr(bo, "histograms", lambda *a: passes.append(len(a[3])) or whole(*a))
    models = lm.train_folds(pairs, "target_click", FEATURES, trees=2, depth=2, least=5)
    assert passes[0] == len(models) == 3 and len(passes) <= 2 * 2 + 1
    alone = lm.train_folds(pairs, "target_click", FEATURES, folds=(1,), trees=2, depth=2, least=5)
    assert alone[1] == models[1]


def test_cuts_are_quantiles(spark):
    from sessionrec.operators.boosting import bin_cuts

    rows = spark.range(40000).selectExpr("id * 1.5D AS x", "cast(id % 3 AS int) AS few", "cast(null AS double) AS none", "if(id < 100, double('nan'), 2D) AS one").repartition(3)
    x, few, none, one = bin_cuts(rows, ["x", "few", "none", "one"], 4)
    assert np.allclose(x, [15000, 30000, 45000], atol=60000 * 0.004) and few == [0, 1, 2] and none == [] and one == [2]
