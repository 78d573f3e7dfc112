import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionrec.operators import block_bpr as bb
from sessionrec.operators import factorization as fz
from sessionrec.sources.stages import materialize, stage_path


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(40).select(F.col("id").cast("int").alias("aid_idx"), F.col("id").alias("aid"))


@pytest.fixture(scope="module")
def examples(spark):
    """Two tastes, one item that holds a third of all rows, and repeated rows."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        x = int(rng.integers(40))
        y = 3 if i % 3 == 0 else int(rng.integers(20) * 2 + x % 2)
        rows.append((x, y, int(rng.integers(5)), 1.0, 1.0))
    rows += [(1, 3, 0, 1.0, 1.0)] * 50
    return materialize(spark.createDataFrame(rows, "x int, y int, key int, coef_x double, coef_y double"), "examples")


def start(ids, seed=1):
    return materialize(fz.initial_vectors(ids, "aid_idx", 4, seed), "start")


def rows(table):
    return {r.id: tuple(r.vec) for r in table.collect()}


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("blocks", [1, 4, 5])
def test_cells_of_a_round_touch_disjoint_ids(examples, shared, blocks):
    strata = bb.deal(examples, shared, blocks, 50)
    assert strata.weight == examples.count() == strata.examples.agg(F.sum("n")).first()[0]
    cells = strata.members.groupBy("round", "side", "id").agg(F.count_distinct("cell").alias("cells"))
    assert cells.agg(F.max("cells")).first()[0] == 1
    # A hot item does not make a hot slice, and repeated rows are one.
    sizes = strata.examples.groupBy("round", "cell", "slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert strata.examples.filter("n >= 50").count() == 1


def test_same_vectors_under_any_partitioning(spark, examples, ids):
    first, _, _ = bb.block_bpr(examples, start(ids), None, 2, 0.05, blocks=3, slice_rows=60, batch=16)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        mixed = examples.repartition(9, "key").sortWithinPartitions(F.col("y").desc())
        again, _, _ = bb.block_bpr(mixed, start(ids), None, 2, 0.05, blocks=3, slice_rows=60, batch=16)
        assert rows(first) == rows(again) and len(rows(first)) == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_mini_batch_against_plain_numpy(spark, ids):
    data = [(0, 1, 0, 1.0, 0.5), (2, 3, 0, 0.5, 1.0), (4, 1, 0, 1.0, 2.0)]
    few = spark.createDataFrame(data, "x int, y int, key int, coef_x double, coef_y double")
    state = {i: np.array(v) for i, v in rows(start(ids)).items()}
    dealt = bb.deal(few, True, 1, 100).examples.orderBy("draw", "x", "y").collect()
    gradient = {i: np.zeros(4) for i in state}
    loss = 0.0
    for r in dealt:
        o = dealt[r.pick % 3]
        cp, cn = r.coef_x * r.coef_y, r.coef_x * o.coef_y
        p = 1 / (1 + np.exp(cn * state[r.x] @ state[o.y] - cp * state[r.x] @ state[r.y]))
        loss -= np.log(p) / 3
        gradient[r.x] -= (1 - p) / 3 * (cp * state[r.y] - cn * state[o.y])
        gradient[r.y] -= (1 - p) / 3 * cp * state[r.x]
        gradient[o.y] += (1 - p) / 3 * cn * state[r.x]
    got, _, losses = bb.block_bpr(few, start(ids), None, 1, 0.05, blocks=1)
    assert losses[0] == pytest.approx(loss, abs=1e-6)
    for i, vec in rows(got).items():
        g = gradient[i]
        assert np.allclose(vec, state[i] - 0.05 * g / (np.abs(g) + 1e-8), atol=1e-6)


def test_beats_full_batch_at_equal_passes(examples, ids):
    coefs = examples.select(
        F.col("x").alias("aid_idx"), F.col("y").alias("next_aid_idx"), F.col("key").alias("ts_diff"), "coef_x", "coef_y"
    )
    _, full = fz.item_bpr(coefs, ids, 4, 3, 0.05, batch=None)
    _, blocks = fz.item_bpr(coefs, ids, 4, 3, 0.05, blocks=2, batch=64)
    assert blocks[-1] < full[-1] - 0.01 and blocks[-1] < blocks[0]


def test_two_tables_and_a_lost_run_that_goes_on(spark, examples, ids):
    def train(epochs, folder=None, score=None):
        return bb.block_bpr(examples, start(ids), start(ids, 2), epochs, 0.05, 2, 500, 64, score=score, folder=folder)

    folder = stage_path(spark, "resume")
    scores = iter([0.3, 0.1])
    calls = []

    def lost(left, right):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return 0.3

    with pytest.raises(RuntimeError, match="lost"):
        train(2, folder, lost)
    left, right, losses = train(2, folder, lambda a, b: 0.9)
    whole_left, whole_right, whole_losses = train(2)
    assert len(calls) == 2 and losses == pytest.approx(whole_losses)
    assert rows(left) == rows(whole_left) and rows(right) == rows(whole_right)
    # Of equal data, the best epoch is kept.
    first, _, _ = train(2, None, lambda a, b: next(scores))
    assert rows(first) != rows(whole_left)


def test_empty_examples(examples, ids):
    got, _, losses = bb.block_bpr(examples.limit(0), start(ids), None, 1, 0.05, blocks=2)
    assert rows(got) == rows(start(ids)) and losses == [0.0]
