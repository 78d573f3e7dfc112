"""Pair weights against a direct computation; blocks must not change them."""

import math
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sessionrec.operators import item_cf as cf
from sessionrec.operators.sessions import session_items


def brute(events, rule):
    """Pair weights by nested loops."""
    latest, sizes = {}, defaultdict(int)
    for s, a, ts, t in events:
        sizes[s] += 1
        latest[s, a, t] = max(ts, latest.get((s, a, t), 0))
    counts = defaultdict(int)
    for _, a, _ in latest:
        counts[a] += 1
    newest = max(e[2] for e in events)
    out = defaultdict(float)
    for (s, a, t), ts in latest.items():
        for (s2, b, t2), ts2 in latest.items():
            if s != s2 or t not in rule.source or t2 not in rule.target:
                continue
            if (rule.future and not ts < ts2) or (rule.drop_self and a == b):
                continue
            w = 2.0 ** (-abs(ts - ts2) / 3600) if rule.decay else 1.0
            if rule.trend:
                w /= newest - ts2 + 1
            if rule.session_size:
                w /= math.log(1 + sizes[s])
            if rule.popularity:
                w /= math.log(math.sqrt(counts[a] * counts[b] + 2))
            out[a, b] += w
    return out


RULES = [
    *cf.RULES,
    cf.PairRule((0,), (1, 2), future=True),
    cf.PairRule(drop_self=True, decay=False),
    cf.PairRule((1,), (1,), session_size=False, popularity=False),
]


@pytest.fixture(scope="module")
def weights(log):
    return {(r.rule, r.aid, r.aid_right): r.weight for r in cf.pair_weights(log, tuple(RULES)).collect()}


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_weights_match_nested_loops(log, weights, rule):
    want = brute([tuple(r)[:4] for r in log.collect()], rule)
    got = {(a, b): w for (name, a, b), w in weights.items() if name == rule.name}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12)


def test_blocks_of_long_sessions_keep_every_pair(train):
    rules = (cf.RULES[0], cf.RULES[6])

    def weights(block):
        rows = cf.pair_weights(train, rules, block).collect()
        return {(r.rule, r.aid, r.aid_right): r.weight for r in rows}

    whole, split = weights(10_000), weights(7)
    assert whole.keys() == split.keys()
    assert all(split[k] == pytest.approx(v, rel=1e-9) for k, v in whole.items())


def test_block_cells_are_bounded(train):
    cells = cf.pair_cells(session_items(train), 7)
    sizes = cells.groupBy("session", "_cell_a", "_cell_b").count().collect()
    longest = session_items(train).groupBy("session").count().agg({"count": "max"}).first()[0]
    assert longest > 30
    assert max(r["count"] for r in sizes) < longest  # no cell holds a whole session


def test_pairs_symmetric_without_trend_and_future(train):
    rows = cf.pair_weights(train, (cf.RULES[0],)).collect()
    weights = {(r.aid, r.aid_right): r.weight for r in rows}
    assert all(weights[b, a] == pytest.approx(w, rel=1e-9) for (a, b), w in weights.items())


def test_std_is_null_for_one_value_and_last_uses_newest(spark, log):
    pairs = spark.createDataFrame(
        [("r", 10, 20, 1.0), ("r", 11, 20, 3.0), ("r", 12, 21, 1.0), ("r", 13, 22, 1.0)],
        "rule string, aid int, aid_right int, weight float",
    )

    class Named(cf.PairRule):
        name = "r"

    rules = (Named(),)
    std = {(r.session, r.aid): r.score for r in cf.neighbour_std(log, pairs, rules).collect()}
    assert std[1, 20] is None and std[2, 20] == pytest.approx(1.0)  # 1, 1, 1, 3
    got = cf.neighbour_scores(log, pairs, rules, ("sum", "last", "count")).collect()
    scores = {(r.session, r.aid, r["agg"]): r.score for r in got}
    assert scores[2, 20, "sum"] == 6.0 and scores[2, 20, "count"] == 4.0
    # Newest event of session 2 is item 10, which it touched three times.
    assert scores[3, 22, "last"] == 1.0 and (3, 21, "last") not in scores


@pytest.mark.parametrize("batch", (7, 10_000))
def test_ranked_neighbours_are_one_row_per_session_and_item(spark, train, batch):
    """Scores, ranks and ties of all generators, also where a session spans Arrow batches."""
    from sessionrec.functions.order import score_ranks, top_k
    from pyspark.sql import functions as F

    rules, aggregations, k = (cf.RULES[0], cf.RULES[3]), ("sum", "count", "last"), 25
    pairs = cf.item_pairs(train, rules, 40).localCheckpoint()
    scored = cf.neighbour_scores(train, pairs, rules, aggregations).select(
        "session", "aid", F.concat_ws("_", "rule", "agg").alias("cg"), F.col("score").cast("float").alias("score")
    )
    best = top_k(scored, ["session", "cg"], [F.col("score").desc(), F.col("aid")], k)
    want = {tuple(r) for r in score_ranks(best, ["session", "cg"]).select("session", "aid", "cg", "rank", "min_rank").collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        packed = cf.ranked_neighbours(train, pairs, rules, aggregations, k).collect()
    finally:
        spark.conf.set(key, before)
    assert len({(r.session, r.aid) for r in packed}) == len(packed)
    names = cf.generator_names(rules, aggregations)
    got = {
        (r.session, r.aid, name, rank, least)
        for r in packed
        for name, rank, least in zip(names, r.ranks, r.min_ranks)
        if rank is not None
    }
    assert got == want


@pytest.mark.parametrize("block", (7, cf.BLOCK_ITEMS))
def test_slices_of_items_keep_every_pair(train, block):
    rules = (cf.RULES[1], cf.RULES[6])

    def found(slices):
        rows = cf.item_pairs(train, rules, 20, block, slices).collect()
        return {(r.rule, r.aid, r.aid_right): r.weight for r in rows}

    whole, sliced = found(1), found(3)
    assert whole.keys() == sliced.keys()
    assert all(sliced[k] == pytest.approx(v, rel=1e-6) for k, v in whole.items())


def test_many_pairs_of_a_large_catalogue_are_sliced(spark, monkeypatch):
    written = []
    monkeypatch.setattr(cf, "PAIRS_PER_SLICE", 1)
    monkeypatch.setattr(cf, "write_stage", lambda df, path, write=cf.write_stage: written.append(write(df, path)))
    rows = [(s, s * 20 + a, 100 + a, 0, s * 20 + a) for s in range(10) for a in range(20)]
    log = spark.createDataFrame(rows, "session int, aid int, ts long, type tinyint, eid long")
    assert cf.item_pairs(log, (cf.RULES[0],)).count() == 10 * 20 * 20
    assert len(written) == 10  # 4,000 pairs, two per item and slice


def test_marked_neighbours_are_the_selected_of_the_ranked(spark, train):
    rules, aggregations = cf.RULES[:3], ("sum", "count")
    pairs = cf.item_pairs(train, rules).localCheckpoint()
    names = cf.generator_names(rules, aggregations)
    bits = {name: (2 * i + 1, 3 + i) for i, name in enumerate(names)}
    want = {}
    for r in cf.ranked_neighbours(train, pairs, rules, aggregations, 6).collect():
        marks = [1 << bits[n][0] for n, rank in zip(names, r.ranks) if rank is not None and rank <= bits[n][1]]
        if marks:
            want[r.session, r.aid] = sum(marks)
    got = cf.marked_neighbours(train, pairs, bits, rules, aggregations, 6).collect()
    assert len(got) == len(want) and {(r.session, r.aid): r.marks for r in got} == want


@pytest.mark.parametrize("aggregations", (cf.MERGED_AGGREGATIONS, ("mean", "last")))
@pytest.mark.parametrize("long_items, at_once", ((cf.LONG_ITEMS, cf.PAIRS_AT_ONCE), (20, 7), (0, 1)))
def test_neighbours_of_a_part_are_summed_as_row_by_row(train, monkeypatch, aggregations, long_items, at_once):
    monkeypatch.setattr(cf, "PAIRS_AT_ONCE", at_once)
    rules = (cf.RULES[0], cf.RULES[1], cf.RULES[7])
    pairs = cf.item_pairs(train, rules, 12).localCheckpoint()
    events = train.withColumn("session", F.expr("nullif(session, 3)"))
    count = len(rules) * len(aggregations)
    schema = "session int, aid int, scores array<float>, ranks array<int>, min_ranks array<int>"
    table = cf.neighbour_table(events, pairs, rules, aggregations)
    want = cf._ordered(table).mapInArrow(cf._batch_ranker(count, cf._ranker(count, 30)), schema)
    got = cf._through_ranker(events, pairs, rules, aggregations, cf._ranker(count, 30), schema, long_items)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_part_gets_the_neighbours_of_an_item_once(train):
    pairs = cf.item_pairs(train, cf.RULES[:1]).localCheckpoint()
    plan = cf.ranked_neighbours(train, pairs, cf.RULES[:1], ("sum",))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan


def test_the_scorer_needs_no_package_in_the_worker():
    scorer = cf._scorer(cf.RULES, cf.MERGED_AGGREGATIONS, cf._ranker(27, 30))
    code = "import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read())"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(scorer), cwd="/", capture_output=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("kind", (np.float32, np.float64))
def test_ranks_by_one_number_equal_ranks_by_sorting(kind):
    """Ties, signs, zeros and unknown scores; 64-bit scores take the plain sort."""
    rng = np.random.default_rng(5)
    session = np.sort(rng.integers(-3, 40, 700))
    score = rng.integers(-4, 5, (700, 2)).astype(kind) / 4
    score[::7] = -score[::7] * 0
    known = rng.random(score.shape) < 0.8
    ids = [pa.array(session), pa.array(np.arange(700))]
    found = cf._ranker(2, 9)(session, score, known, ids).to_pydict()
    got = {(aid, g): r for aid, ranks in zip(found["aid"], found["ranks"]) for g, r in enumerate(ranks) if r}
    want = {}
    for g in range(2):
        for s in set(session):
            rows = [i for i in range(700) if session[i] == s and known[i, g]]
            rows.sort(key=lambda i: (-score[i, g], i))
            want.update({(i, g): n + 1 for n, i in enumerate(rows[:9])})
    assert got == want


def test_ranks_are_found_without_sorting_by_several_keys(monkeypatch):
    monkeypatch.setattr(np, "lexsort", None)
    score = np.array([[1], [2], [1]], np.float32)
    out = cf._ranker(1, 2, [(3, 2)])(np.array([7, 7, 8]), score, score > 0, [pa.array([7, 7, 8]), pa.array([1, 2, 3])])
    assert out["marks"].to_pylist() == [8, 8, 8]


def test_pairs_are_summed_once_per_pair_of_types(train):
    plain = tuple(r for r in cf.RULES if not (r.trend or r.future))
    plan = cf.pair_weights(train, plain)._jdf.queryExecution().optimizedPlan().toString()
    summing = next(line for line in plan.splitlines() if "Aggregate [a" in line)
    assert summing.count("AS sum_") == 9
    rows = {(r.rule, r.aid, r.aid_right): r.weight for r in cf.pair_weights(train, plain).collect()}
    assert all(rows[rule, b, a] == pytest.approx(w) for (rule, a, b), w in rows.items() if rule == plain[0].name)


def test_cells_are_written_once(train, monkeypatch):
    written = []
    monkeypatch.setattr(cf, "materialize", lambda df, name, cut=cf.materialize: written.append(name) or cut(df, name))
    monkeypatch.setattr(cf.Scratch, "table", lambda *a: pytest.fail("packed cells are for slices only"))
    assert cf.item_pairs(train, cf.RULES[:1], slices=1).count()
    assert written == ["session-items", "counted-cells"]


def test_events_without_item_form_no_pairs(spark):
    rows = [(1, 5, 100, 0, 1), (1, 6, 100, 0, 2), (1, None, 100, 0, 3)]
    log = spark.createDataFrame(rows, "session int, aid int, ts long, type tinyint, eid long")
    got = {(r.aid, r.aid_right): r.weight for r in cf.pair_weights(log, (cf.PairRule(popularity=False),)).collect()}
    assert set(got) == {(5, 5), (5, 6), (6, 5), (6, 6)}
    assert got[5, 6] == pytest.approx(1 / np.log(3))
