import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sessionrec.operators import factorization as fz
from sessionrec.operators import vectors as vx


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    rows.append((40, rows[3][1]))  # an exact copy: ties are broken by id
    rows.append((41, [0.0] * 6))
    return spark.createDataFrame(rows, "aid int, vec array<double>")


def brute(items, k):
    ids, m = [r.aid for r in items], np.array([r.vec for r in items])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(norm == 0, 1, norm)
    scores = np.round(unit @ unit.T, 9)
    return {
        ids[i]: [j for _, j in sorted((-s, ids[j]) for j, s in enumerate(scores[i]))[:k]]
        for i in range(len(ids))
    }


@pytest.mark.parametrize("blocks", [(1000, 1000), (5, 7)])
def test_search_is_exact_in_any_blocks(items, blocks):
    found = vx.vector_topk(
        items.withColumnRenamed("aid", "seed"), items, 5, query="seed",
        item_block=blocks[0], query_block=blocks[1],
    )
    got = {}
    for r in found.orderBy("seed", F.col("score").desc(), "aid").collect():
        got.setdefault(r.seed, []).append(r.aid)
    assert got == brute(items.collect(), 5)


def test_seq_query_repeats_short_histories(spark, items):
    rows = [(1, 2, 10, 0, 1), (1, 5, 20, 0, 2), (2, 7, 10, 0, 3)]
    events = spark.createDataFrame(rows, "session int, aid int, ts long, type tinyint, eid long")
    vec = {r.aid: np.array(r.vec) for r in items.collect()}
    weights = np.linspace(1.0, 0.2, 17)
    got = {r.session: np.array(r.vec) for r in vx.seq_query(events, items).collect()}
    want = sum(w * vec[[5, 2][i % 2]] for i, w in enumerate(weights))
    assert np.allclose(got[1], want) and np.allclose(got[2], weights.sum() * vec[7])


def test_candidates_of_last_equal_search_by_session(spark, items):
    rows = [(s, s % 9, 10 + s, 0, s) for s in range(30)]
    events = spark.createDataFrame(rows, "session int, aid int, ts long, type tinyint, eid long")
    fast = vx.embedding_candidates(events, items, "x", "last", 5)
    slow = vx.as_candidates(vx.vector_topk(vx.last_query(events, items), items, 5), "x")
    assert fast.exceptAll(slow.select(fast.columns)).isEmpty() and fast.count() == slow.count()


def test_bpr_lowers_the_loss_and_keeps_the_best(train):
    ids = fz.item_ids(train)
    coefs = fz.pair_coefs(fz.lag_pairs(train, ids), train, ids)
    # Coefficients near one make the effect visible within a few steps.
    coefs = coefs.withColumn("coef_x", F.lit(1.0)).withColumn("coef_y", F.lit(1.0))
    vectors, losses = fz.item_bpr(coefs, ids, factors=4, epochs=6, lr=0.1)
    assert losses[-1] < losses[0] and vectors.count() == ids.count()
    seen, scores = [], iter([0.1, 0.9, 0.5])

    def rows(table):
        return {r.aid: tuple(r.vec) for r in table.collect()}

    def judge(table):
        seen.append(rows(table))
        return next(scores)

    best, _ = fz.item_bpr(coefs, ids, factors=4, epochs=3, lr=0.1, score=judge)
    assert rows(best) == seen[1] and seen[1] != seen[2]


def test_als_vectors_cover_all_items(train):
    ids = fz.item_ids(train)
    coefs = fz.pair_coefs(fz.lag_pairs(train, ids), train, ids)
    vectors = fz.item_factors(coefs, ids, rank=4, iterations=2)
    assert vectors.count() == ids.count()


@pytest.mark.parametrize("task", [vx._cell_search("q", "aid", 5), fz._batch_gradients(10, 1)])
def test_task_functions_load_without_the_package(task):
    data = cloudpickle.dumps(task).hex()
    load = "import pickle, sys; pickle.loads(bytes.fromhex(sys.argv[1]))"
    subprocess.run([sys.executable, "-I", "-c", load, data], check=True, cwd="/")


def test_head_of_a_search_is_the_first_rows_of_the_whole(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 4))
    # Close scores: equal as 32-bit floats, apart as doubles, so ids break the tie.
    vectors = [(int(i), [float(x) for x in base[i % 6] * 3 + (i % 5) * 4e-8]) for i in range(60)]
    items = spark.createDataFrame(vectors, "aid int, vec array<double>")
    events = spark.createDataFrame(
        [(s, s % 60, s, 0, s) for s in range(80)], "session int, aid int, ts int, type int, eid long"
    )
    for seed in ("last", "seq"):
        whole = vx.embedding_candidates(events, items, "x", seed, 30).filter("rank <= 7")
        head = vx.embedding_candidates(events, items, "x", seed, 30, head=7)
        assert head.columns == whole.columns
        assert sorted(map(tuple, head.collect())) == sorted(map(tuple, whole.collect()))


def test_seq_query_sends_an_item_once_per_part(spark, items):
    rows = [(s, a % 45, 10 * a + s, 0, 100 * s + a) for s in range(20) for a in range(s, s + 2 * s % 23)]
    events = spark.createDataFrame(rows, "session int, aid int, ts long, type tinyint, eid long")
    events = events.selectExpr("nullif(session, 4) AS session", "aid", "ts", "type", "eid")
    vec = {r.aid: np.array(r.vec) for r in items.collect()}
    found = vx.seq_query(events, items)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {r.session: np.array(r.vec) for r in found.collect()}
    weights = np.linspace(1.0, 0.2, 17)
    want = {}
    for s, a, ts, _, _ in sorted(rows, key=lambda r: -r[2]):
        if a in vec:
            want.setdefault(None if s == 4 else s, []).append(vec[a])
    assert set(got) == set(want)
    for s, found in want.items():
        newest = found[:17]
        assert np.allclose(got[s], sum(w * newest[i % len(newest)] for i, w in enumerate(weights)))


def test_seq_query_of_uneven_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [5.0, None])], "aid int, vec array<double>")
    rows = [(1, 1, 10, 0, 1), (2, 2, 10, 0, 2), (3, 3, 10, 0, 3)]
    events = spark.createDataFrame(rows, "session int, aid int, ts long, type tinyint, eid long")
    total = float(np.linspace(1.0, 0.2, 17).sum())
    got = {r.session: r.vec for r in vx.seq_query(events, items).collect()}
    assert got[1] == pytest.approx([total, 2 * total]) and got[2] is None
    assert got[3][0] == pytest.approx(5 * total) and got[3][1] is None


def test_head_of_a_search_sorts_few_scores(spark, items):
    queries = items.withColumnRenamed("aid", "seed")
    search = vx._cell_search("seed", "aid", 30, 3)
    sizes, sort = [], np.lexsort
    left = queries.toPandas().rename(columns={"vec": "_query_vec"})
    right = items.toPandas().rename(columns={"vec": "_item_vec"})
    try:
        np.lexsort = lambda keys: sizes.append(len(keys[0])) or sort(keys)
        got = search(left, right)
    finally:
        np.lexsort = sort
    assert max(sizes) < 42 * 10  # the zero vectors tie with all others
    whole = vx._cell_search("seed", "aid", 30)(left, right)
    stored = whole.score.astype("float32")
    third = stored.groupby(whole.seed).transform(lambda s: s.iloc[2])
    assert got.reset_index(drop=True).equals(whole[stored >= third].reset_index(drop=True))
