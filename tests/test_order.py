"""Ranks, positions and following rows; hot groups must give the same result."""

import hashlib

from pyspark.sql import functions as F

from sessionrec.functions import order as od
from sessionrec.operators import factorization as fz
from sessionrec.operators import features_user as fu
from sessionrec.operators.history import all_history_candidates


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_hot_groups_lists_only_large_groups(log):
    assert od.hot_groups(log, ["session"], 10) is None
    hot = od.hot_groups(log, ["session"], 3)
    assert [r.session for r in hot.collect()] == [2]


def test_score_ranks_ties(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 4, 7.0)], "session int, aid int, score double")
    got = {r.aid: (r["rank"], r.min_rank) for r in od.score_ranks(df, ["session"]).collect()}
    assert got == {4: (1, 1), 3: (2, 2), 5: (3, 2)}


def test_score_ranks_same_for_hot_sessions(train):
    hot = od.hot_groups(train, ["session"], 30)
    assert hot is not None
    assert rows(all_history_candidates(train, hot)) == rows(all_history_candidates(train))


def test_hot_paths_with_nulls_nan_and_ties(spark):
    nan = float("nan")
    values = [(1, 5, 2.0), (1, 3, None), (1, 4, None), (1, 6, 2.0), (1, 7, nan), (2, 1, None), (2, 2, 1.0), (None, 8, 1.0)]
    df = spark.createDataFrame([(*v, v[1], v[1]) for v in values], "session int, aid int, score double, ts int, eid int")
    hot = od.hot_groups(df, ["session"], 2)
    assert [r.session for r in hot.collect()] == [1]
    order = [F.col("score").desc(), F.col("aid").asc()]
    for function in (
        lambda h: od.score_ranks(df, ["session"], hot=h),
        lambda h: od.positions(df, ["session"], order, "p", h),
        lambda h: od.following(df, ["session"], order, ["aid", "score"], 2, h),
        lambda h: od.item_lists(df, 2, h),
    ):
        assert list(map(repr, rows(function(hot)))) == list(map(repr, rows(function(None))))
    assert od.score_ranks(df, ["session"], hot=hot).count() == len(values)
    placed = od.sliced_positions(df, ["session"], order, "p").collect()
    assert len(placed) == len(values) and {r.p for r in placed if r.session is None} == {0}


def test_sample_of_everything_keeps_everything(train):
    from sessionrec.sources.events import sample_sessions

    labels = train.select("session").distinct()
    assert sample_sessions(train, train, labels, 1.0)[0].count() == train.count()


def test_sample_has_the_size_of_the_draws(spark):
    from sessionrec.sources.events import draw_sessions, sample_sessions

    train = spark.range(1000).selectExpr("cast(id % 400 as int) as session", "cast(id as int) as aid")
    test = train.filter("session < 100")
    places = {int(hashlib.md5(f"train:{j}:5".encode()).hexdigest()[:15], 16) % 400 for j in range(200)}
    assert {r.session for r in draw_sessions(train, 0.5, "train", 5).collect()} == places and len(places) < 200
    got = [{r.session for r in t.collect()} for t in sample_sessions(train, test, test, 0.5, 5)]
    assert got[1] == got[2] and got[1] <= got[0] and places == got[0] - (got[1] - places)
    assert draw_sessions(train.limit(0), 0.5, "train").collect() == []


def test_positions_same_for_hot_sessions(train):
    hot = od.hot_groups(train, ["session"], 30)
    plain = od.positions(train, ["session"], od.oldest_first(), "p")
    split = od.positions(train, ["session"], od.oldest_first(), "p", hot)
    assert rows(plain) == rows(split)


def test_following_same_for_hot_sessions(train):
    hot = od.hot_groups(train, ["session"], 30)
    args = (["session"], od.newest_first(), ["aid", "ts"], 4)
    assert rows(od.following(train, *args)) == rows(od.following(train, *args, hot))


def test_following_gives_each_lag(log):
    got = od.following(log.select("session", "aid", "ts", "eid"), ["session"], od.newest_first(), ["aid"], 4)
    pairs = {(r.session, r.aid, r.lag, r.next_aid) for r in got.collect()}
    assert (2, 10, 1, 11) in pairs and (2, 11, 2, 10) in pairs
    assert (3, 13, 1, 12) in pairs  # same second: larger eid is newer
    assert not any(s in (1, 5) for s, *_ in pairs)
    assert len([p for p in pairs if p[0] == 2]) == 6


def test_global_positions_are_consecutive(train):
    got = od.global_positions(train, [F.col("ts").asc(), F.col("eid").asc()], "p").orderBy("p").collect()
    assert [r.p for r in got] == list(range(train.count()))
    assert [(r.ts, r.eid) for r in got] == sorted((r.ts, r.eid) for r in got)


def test_item_lists_in_parts(train):
    whole = od.item_lists(train, 10_000)
    hot = od.hot_groups(train, ["session"], 30)
    parts = od.item_lists(train, 7, hot)
    assert parts.agg(F.max(F.size("aids"))).first()[0] == 7
    joined = (
        parts.groupBy("session")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "aids"))), lambda e: e.aids)).alias("aids"))
    )
    assert rows(joined) == rows(whole.drop("part"))


def test_ordered_features_same_for_hot_sessions(train):
    hot = od.hot_groups(train, ["session"], 30)
    assert rows(fu.user_inter_ts_diff(train, hot)) == rows(fu.user_inter_ts_diff(train))
    ranks = fu.user_item_first_inter_rank
    assert rows(ranks(train, True, hot)) == rows(ranks(train, True))


def test_dense_ids_start_at_zero(log):
    ids = fz.item_ids(log).orderBy("aid").collect()
    assert [(r.aid, r.aid_idx) for r in ids] == [(a, a - 10) for a in range(10, 17)]


def test_lag_pairs_point_to_earlier_events(log):
    got = fz.lag_pairs(log, fz.item_ids(log)).collect()
    assert all(r.ts_diff >= 0 for r in got)
    assert (1, 0, 40) in {(r.aid_idx, r.next_aid_idx, r.ts_diff) for r in got}
