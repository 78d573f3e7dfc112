"""All stages on the smallest tables, and each registered query against its SQL."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from sessionrec.operators import merge as mg
from sessionrec.operators import rankers as rk
from sessionrec.operators.item_cf import RULES
from sessionrec.plans.pipeline import Pipeline, Settings
from sessionrec.sources import events as log
from sessionrec.sources import fixtures as fx
from sessionrec.sources.stages import stage_path

SMALL = Settings(
    rules=RULES[:1],
    generators=tuple(
        g
        for g in mg.ALL_GENERATORS
        if not g.name.startswith("item_cf") or g.name.startswith(RULES[0].name + "_")
    ),
    factors=4,
    factor_iterations=2,
    vector_size=4,
    vector_iterations=1,
    candidates=50,
    folds=(0, 1, 2),
    kind="pairwise",
    ranker={"rounds": 1, "iterations": 5},
)


def test_pipeline_end_to_end(spark, sf):
    history = fx.train_events(spark, sf)
    labels = log.as_labels(fx.raw_labels(spark, sf))
    pipe = Pipeline(spark, stage_path(spark, "pipeline"), SMALL)
    result = pipe.run(history.filter("session < 0"), history, labels).first()
    assert 0 < result.recall <= 1 and result.null_ratio < 1
    merged = pipe.table("merged")
    assert {f"{g.name}_score" for g in SMALL.generators} <= set(merged.columns)
    assert {r.target for r in pipe.table("scores").select("target").distinct().collect()} == set(rk.TARGETS)
    # Another run over the same root starts again at scoring, with the saved models.
    before = pipe.table("scores").groupBy("target").sum("pred_score").collect()
    restarted = Pipeline(spark, pipe.root, SMALL)
    restarted.score()
    after = {r.target: r[1] for r in restarted.table("scores").groupBy("target").sum("pred_score").collect()}
    assert {r.target: r[1] for r in before} == pytest.approx(after)
    assert restarted.evaluate().first().recall == result.recall


def test_submission_mode_has_no_labels(spark, sf):
    history = fx.test_events(spark, sf)
    pipe = Pipeline(spark, stage_path(spark, "submission"), Settings(
        rules=RULES[:1], generators=mg.HISTORY, tables=Settings().tables[:2]))
    pipe.preprocess(history.filter("session < 0"), history, None)
    pipe.generate()
    assert "fold" not in pipe.merge().columns
    assert pipe.features().count() > 0


QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize(
    "name",
    [
        "load_labels", "lag_pairs", "item_cf_pairs", "cand_item_cf_last", "candidate_votes",
        "negative_sample", "candidates_with_features", "vector_topk", "query_vec_seq",
        "recall_curve", "recall_padded", "ndcg_at_20", "feat_user_ts_gap", "group_kfold",
    ],
)
def test_query_matches_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert differences(got, connect(sf).execute(SQL[name]).df()) is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 < row.recall_20 <= 1
