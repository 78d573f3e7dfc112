from pyspark.sql import functions as F

from sessionrec.operators import evaluation as ev
from sessionrec.sources.events import LABEL_SCHEMA

LISTS = "session int, type tinyint, y_pred array<int>"


def labels(spark, rows):
    return spark.createDataFrame(rows, LABEL_SCHEMA)


def test_recall_counts_missing_predictions_as_empty(spark):
    truth = labels(spark, [(6, 0, [1, 2]), (8, 1, list(range(1, 26))), (9, 2, [4, 4, 5])])
    lists = spark.createDataFrame(
        [(7, 0, [3]), (8, 1, list(range(1, 41))), (9, 2, [4])], LISTS
    )
    got = ev.recall_at_k(truth, lists, 20).first()
    assert got.recall_click == 0.0 and got.recall_cart == 1.0
    assert got.recall_order == 1 / 3  # duplicate truth counts in the size, not in the hits
    assert abs(got.recall - (0.3 + 0.6 / 3)) < 1e-12
    assert abs(got.null_ratio - 1 / 3) < 1e-12


def test_padding_uses_the_list_of_the_type(spark):
    truth = labels(spark, [(1, 0, [7]), (1, 1, [8]), (1, 2, [8])])
    lists = spark.createDataFrame([(1, 0, [1, 2])], LISTS)
    clicks = spark.createDataFrame([([7, 9],)], "items array<int>")
    orders = spark.createDataFrame([([8],)], "items array<int>")

    def recalls(**popular):
        r = ev.recall_at_k(truth, lists, 3, **popular).first()
        return r.recall_click, r.recall_cart, r.recall_order

    assert recalls(popular_clicks=clicks, popular_orders=orders) == (1.0, 1.0, 1.0)
    assert recalls(popular_orders=orders) == (0.0, 1.0, 1.0)
    assert recalls() == (0.0, 0.0, 0.0)


def test_recall_curve_matches_lists(spark, train):
    from sessionrec.operators.history import history_candidates

    ranked = history_candidates(train, "inter")
    truth = (
        train.groupBy("session", "type")
        .agg(F.array_sort(F.collect_set("aid")).alias("ground_truth"))
        .unionByName(labels(spark, [(999999, 0, [1])]))
    )
    curve = ev.recall_curve(truth, ranked, (5, 20)).first()
    for k in (5, 20):
        lists = ev.for_all_types(ev.top_lists(ranked, k, "score"))
        one = ev.recall_at_k(truth, lists, k).first()
        assert abs(curve[f"recall_{k}"] - one.recall) < 1e-12
        assert abs(curve.null_ratio - one.null_ratio) < 1e-12
        assert 0 <= one.recall <= 1


def test_ndcg_of_perfect_order_is_one(spark):
    rows = [(1, 10, 0.9, 1), (1, 11, 0.5, 1), (1, 12, 0.1, 0), (2, 10, 0.5, 0)]
    df = spark.createDataFrame(rows, "session int, aid int, pred_score double, target_click int")
    got = ev.ndcg_at_k(df, "target_click").first()
    assert got.ndcg == 1.0 and got.sessions == 1


def test_empty_labels_keep_schema(spark):
    from sessionrec.sources.events import empty_labels

    empty = empty_labels(spark)
    lists = spark.createDataFrame([(1, 0, [1])], LISTS)
    got = ev.recall_at_k(empty, lists).first()
    assert got.recall == 0.0 and got.recall_click is None
