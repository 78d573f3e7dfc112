import pytest

from sessionrec.operators import features_item as fi
from sessionrec.operators import features_user as fu
from sessionrec.operators.feature_merge import FEATURE_TABLES, build_features, merge_features


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_item_counts_and_ranks(log):
    counts, ranks = by(fi.item_inter_num(log), "aid"), by(fi.item_inter_rank(log), "aid")
    assert counts[10].item_inter_num_3d == 4 and counts[10].item_buy_num_21d == 2
    assert ranks[10].item_inter_rank_3d == 1 and ranks[16].item_inter_rank_3d == 7
    assert ranks[16].item_click_rank_3d == 0


def test_repeat_probability(log):
    got = by(fi.item_multi_inter_prob(log), "aid")
    assert got[10].item_multi_inter_prob == 0.5  # twice seen, repeated in one session
    assert got[10].item_multi_click_prob == 0.0 and got[16].item_multi_click_prob == -1.0


def test_conversion_without_denominator(log):
    got = by(fi.item_type_to_type_prob(log, recent=True), "aid")
    assert got[16].item_click_to_cart_prob_3d == -1.0
    assert got[10].item_click_to_cart_prob_3d == 0.5
    assert fi.item_type_to_type_prob(log).isEmpty()  # nothing is older than three days


def test_session_features(log):
    num, gaps = by(fu.user_inter_num(log), "session"), by(fu.user_inter_ts_diff(log), "session")
    assert num[4].user_click_num == -1 and num[2].user_buy_num == 2
    assert gaps[1].user_inter_ts_diff_min == -1.0
    assert gaps[2].user_inter_ts_diff_max == 100.0 and gaps[2].user_click_ts_diff_mean == 100.0
    assert gaps[2].user_click_ts_diff_std == -1.0
    dow = by(fu.user_inter_dow(log), "session")
    assert dow[1].user_first_inter_dow == 3 and dow[1].user_first_buy_dow == -1  # a Thursday
    diff = by(fu.user_ts_diff(log), "session")
    assert diff[2].user_ts_diff == 200 and diff[3].user_min_all_min_ts_diff == 400


def test_item_places(log):
    published = by(fu.user_item_first_inter_rank(log), "session", "aid")
    assert published[2, 10].user_item_first_inter_rank == 0
    assert published[2, 11].user_item_first_inter_rank == 1
    assert published[2, 11].user_item_first_buy_rank == -1
    assert published[2, 10].user_item_last_inter_rank == -1
    full = by(fu.user_item_first_inter_rank(log, by_type=True), "session", "aid")
    assert full[2, 10].user_item_last_inter_rank == 0
    assert full[2, 11].user_item_last_inter_rank == 2


def test_item_at_the_ends(log):
    published = by(fu.user_item_is_first_inter(log), "session", "aid")
    assert set(published) == {(1, 10), (2, 10), (3, 13), (4, 15), (5, 16)}
    assert published[2, 10].user_item_is_last_inter == 1
    assert published[4, 15].user_item_is_first_click == 0
    assert (3, 12) in by(fu.user_item_is_first_inter(log, all_pairs=True), "session", "aid")


def test_merge_fills_and_casts(spark, log):
    pairs = spark.createDataFrame([(2, 10), (99, 99)], "session int, aid int")
    merged = merge_features(pairs, build_features(log, log))
    assert merged.count() == 2 and len(merged.columns) == 132  # two keys, 130 features
    got = by(merged, "session")
    assert got[99].item_inter_num_3d == 0 and got[99].user_inter_num == -1
    assert got[99].item_multi_inter_prob == pytest.approx(-1.0)
    types = dict(merged.dtypes)
    assert types["user_first_inter_dow"] == "tinyint" and types["item_inter_ts_std"] == "float"
    assert not any(v is None for r in got.values() for v in r)


def test_merge_only_wanted_features(spark, log):
    pairs = spark.createDataFrame([(2, 10)], "session int, aid int")
    merged = merge_features(pairs, build_features(log, log, FEATURE_TABLES[:1]), {"item_cart_num_7d"})
    assert merged.columns == ["session", "aid", "item_cart_num_7d"]
