import random

import pytest
from pyspark.sql import functions as F

from sessionrec.operators import merge as mg
from sessionrec.operators import rankers as rk
from sessionrec.operators import sampling as sp
from sessionrec.sources.events import LABEL_SCHEMA

GENERATORS = (mg.Generator("a", 1, 2.0), mg.Generator("b", 2, 0.7))


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [
        (1, 10, "a", 3.0, 1, 1), (1, 11, "a", 2.0, 2, 2), (1, 12, "a", 1.0, 3, 3),
        (1, 11, "b", 5.0, 1, 1), (1, 10, "b", 4.0, 2, 2), (1, 13, "b", 1.0, 3, 3),
        (2, 10, "b", 1.0, 1, 1), (2, 10, "other", 1.0, 1, 1),
    ]
    return spark.createDataFrame(
        rows, "session int, aid int, cg string, score float, rank int, min_rank int"
    )


def test_wide_keeps_scores_beyond_the_head(candidates):
    got = {(r.session, r.aid): r for r in mg.wide_candidates(candidates, GENERATORS).collect()}
    assert set(got) == {(1, 10), (1, 11), (2, 10)}
    assert got[1, 11].a_score == 2.0 and got[1, 11].a_score_selected == 0
    assert got[2, 10].a_score == -1.0 and got[2, 10].a_score_rank == -1
    heads = {(r.session, r.aid) for r in mg.selected_pairs(candidates, GENERATORS).collect()}
    assert heads == set(got)


def test_votes(candidates):
    voted = mg.add_votes(mg.wide_candidates(candidates, GENERATORS), GENERATORS)
    got = {(r.session, r.aid): r for r in voted.collect()}
    assert got[1, 10].cand_feature_selected_num == 2
    assert got[1, 10].cand_feature_selected_score == pytest.approx(2.7)
    assert got[1, 11].cand_feature_selected_rank == 2


def test_labels_targets_and_folds(spark, candidates):
    labels = spark.createDataFrame([(1, 0, [10, 10]), (1, 2, [11]), (3, 1, [1])], LABEL_SCHEMA)
    wide = mg.wide_candidates(candidates, GENERATORS)
    merged = mg.add_votes(mg.add_folds(mg.label_candidates(wide, labels)), GENERATORS)
    got = {(r.session, r.aid): r for r in merged.collect()}
    assert set(got) == {(1, 10), (1, 11)}  # session 2 has no positive row, no row doubled
    assert got[1, 10].target_click == 1 and got[1, 10].no_target_cart == 1
    assert {r.fold for r in got.values()} == {0}
    unlabelled = mg.add_votes(wide, GENERATORS)
    assert "target_click" not in unlabelled.columns and unlabelled.count() == 3


def test_folds_are_balanced_and_constant_in_a_session(train):
    pairs = train.select("session", "aid").distinct()
    folded = mg.add_folds(pairs)
    assert folded.groupBy("session").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    largest = pairs.groupBy("session").count().agg(F.max("count")).first()[0]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= largest
    assert folded.count() == pairs.count()


def test_sampling_keeps_positives_and_is_repeatable(spark):
    df = spark.range(4000).select(
        (F.col("id") % 50).cast("int").alias("session"),
        F.col("id").cast("int").alias("aid"),
        (F.col("id") % 10 == 0).cast("int").alias("target_click"),
        F.lit(0).alias("target_cart"),
        F.lit(0).alias("target_order"),
    )
    sampled = sp.sample_negatives(df)
    assert sampled.filter("target_click = 1").count() == 400
    negatives = sampled.filter("target_click = 0").count()
    assert 1620 < negatives < 1980
    again = sp.sample_negatives(df.repartition(7))
    assert sampled.exceptAll(again).isEmpty() and again.count() == sampled.count()
    shuffled = sp.shuffle_in_session(sampled)
    assert shuffled.groupBy("session").agg((F.max("position") - F.count("*")).alias("d")).filter("d <> 0").isEmpty()


def test_target_rows(spark):
    rows = [(1, 0, 1, 0, 1, 0), (1, 0, 0, 1, 1, 0), (2, 0, 0, 0, 1, 1), (3, 0, 1, 0, 0, 0)]
    df = spark.createDataFrame(
        rows,
        "session int, target_click int, target_cart int, target_order int, no_target_cart int, no_target_order int",
    )
    assert rk.with_target_rows(df, "target_buy").count() == 2  # the ordered row and session 3
    assert rk.with_target_rows(df, "target_buy", session_level=True).count() == 3
    assert rk.with_target_rows(df, "target_inter").count() == 4
    got = rk.add_targets(df).collect()
    assert [r.target_buy for r in got] == [1, 1, 0, 1]


def test_unknown_label_type_fails(spark):
    from sessionrec.sources.events import as_labels

    raw = spark.createDataFrame([(1, "views", [1])], "session int, type string, ground_truth array<int>")
    with pytest.raises(Exception, match="unknown label type"):
        as_labels(raw).collect()


def brute_folds(sizes, folds):
    """sizes: session -> rows."""
    loads, out = [0] * folds, {}
    for session, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        out[session] = loads.index(min(loads))
        loads[out[session]] += n
    return out


@pytest.mark.parametrize("seed", range(60))
def test_dealt_sizes_follow_the_greedy_rule(seed):
    rnd = random.Random(seed)
    folds = rnd.randint(1, 5)
    counts = [(n, rnd.randint(1, 30)) for n in rnd.sample(range(1, rnd.choice([8, 300])), rnd.randint(1, 6))]
    sizes = {}
    for n, count in sorted(counts, reverse=True):
        sizes |= {len(sizes) + i: n for i in range(count)}
    got = []
    rule = {n: (first, cycle) for n, first, cycle in mg._dealt(counts, folds)}
    for n, count in sorted(counts, reverse=True):
        first, cycle = rule[n]
        got += [first[i] if i < len(first) else cycle[(i - len(first)) % folds] for i in range(count)]
    assert got == [*brute_folds(sizes, folds).values()]


def test_session_folds_equal_the_greedy_rule(spark):
    rnd = random.Random(5)
    sizes = {s: rnd.choice([1, 1, 1, 2, 3, 40, rnd.randint(1, 90)]) for s in range(300)}
    rows = [(s, a) for s, n in sizes.items() for a in range(n)]
    pairs = spark.createDataFrame(rows, "session int, aid int").repartition(6)
    assert {r.session: r.fold for r in mg.session_folds(pairs, 3).collect()} == brute_folds(sizes, 3)
    assert mg.session_folds(pairs.limit(0)).collect() == []


def test_families_give_the_rows_of_the_long_table(spark, candidates):
    shared = candidates.filter("cg = 'a'")
    families = [
        mg.packed_family(candidates.filter("cg <> 'a'"), ("b", "other")),
        mg.single_family(shared, ("a", "again")),
    ]
    generators = (*GENERATORS, mg.Generator("again", 2), mg.Generator("absent"))
    long = candidates.unionByName(shared.withColumn("cg", F.lit("again")))
    want = mg.wide_candidates(long, generators)
    got = mg.wide_of_families(families, generators, 3)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    heads = mg.selected_of_families(families, generators, 3).collect()
    assert sorted(map(tuple, heads)) == sorted(tuple(r)[:2] for r in want.collect())


def test_marks_give_the_heads_and_votes_of_the_families(spark, candidates):
    shared = candidates.filter("cg = 'a'")
    generators = (*GENERATORS, mg.Generator("again", 2), mg.Generator("absent"))
    bits = mg.generator_bits(generators)
    marked = [
        mg.marked_candidates(candidates.filter("cg = 'b'"), {"b": bits["b"]}),
        mg.marked_search(shared, ("a", "again"), bits),
    ]
    wide = mg.wide_candidates(candidates.unionByName(shared.withColumn("cg", F.lit("again"))), generators)
    got = mg.votes_of_marks(marked, generators, 3)
    want = mg.add_votes(wide, generators).select(got.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    heads = mg.selected_of_marks(marked, 3).collect()
    assert sorted(map(tuple, heads)) == sorted(tuple(r)[:2] for r in wide.collect())
