"""Skip-gram: pairs of long sessions, noise in proportion, vectors that group related items."""

from collections import Counter

import numpy as np
import pytest

from sessionrec.functions.order import hot_groups
from sessionrec.operators import skip_gram as sg
from sessionrec.sources.stages import materialize

EVENTS = "session int, aid int, ts long, eid long"


@pytest.fixture(scope="module")
def events(spark):
    """Two tastes; session 0 holds 2,500 events of both in long stretches."""
    rng = np.random.default_rng(3)
    rows = [(0, int(rng.integers(10)) * 2 + (i // 50) % 2, i, i) for i in range(2500)]
    for s in range(1, 120):
        rows += [(s, int(rng.integers(10)) * 2 + s % 2, i, s * 1000 + i) for i in range(12)]
    return materialize(spark.createDataFrame(rows, EVENTS), "skip-gram-log")


def test_pairs_cross_every_border_and_hot_sessions_agree(events):
    pairs = Counter((r.x, r.y, r.key) for r in sg.context_pairs(events).collect())
    assert max(pairs.values()) == 1
    apart = Counter((r.x, r.y, r.key) for r in sg.context_pairs(events, hot=hot_groups(events, ["session"], 100)).collect())
    assert pairs == apart
    keys = {k for *_, k in pairs}
    # Every event but the last reaches one event at least, those at 1,000 as well.
    assert {f"0:{i}:1:after" for i in range(2499)} <= keys and {f"0:{i}:1:before" for i in range(2499)} <= keys
    assert max(int(k.split(":")[2]) for k in keys) == 5


def test_noise_follows_the_power_and_draws_follow_the_noise(events):
    noise = sorted((r.aid, r.start, r.stop) for r in sg.noise_table(events).collect())
    counts = Counter(r.aid for r in events.collect())
    assert noise[0][1] == 0 and all(a[2] == b[1] for a, b in zip(noise, noise[1:]))
    assert [b - a for _, a, b in noise] == [round(counts[aid] ** 0.75 * 1024) for aid, *_ in noise]
    pairs = materialize(sg.context_pairs(events), "pairs")
    drawn = sg.negative_draws(pairs, sg.noise_table(events), 4).collect()
    share = Counter(r.y for r in drawn)
    for aid, a, b in noise:
        assert share[aid] / len(drawn) == pytest.approx((b - a) / noise[-1][2], abs=0.01)
    empty = events.limit(0)
    assert sg.negative_draws(sg.context_pairs(empty), sg.noise_table(empty)).collect() == []


def test_vectors_group_tastes_whatever_the_partitioning(spark, events):
    def fit(log):
        return sg.skip_gram(log, vector_size=8, epochs=6, lr=0.1, blocks=2, slice_rows=4000, batch=256)

    vectors, losses = fit(events)
    found = {r.aid: np.array(r.vec) / np.linalg.norm(r.vec) for r in vectors.collect()}
    assert len(found) == 20 and losses[-1] < losses[0]
    same = np.mean([found[a] @ found[b] for a in found for b in found if a < b and a % 2 == b % 2])
    other = np.mean([found[a] @ found[b] for a in found for b in found if a % 2 != b % 2])
    # All vectors share a direction, as draws outnumber pairs; tastes are told apart within it.
    nearest = {a: max((b for b in found if b != a), key=lambda b: found[a] @ found[b]) for a in found}
    assert same > other and all(a % 2 == b % 2 for a, b in nearest.items())
    again, _ = fit(events.repartition(7))
    assert {r.aid: tuple(r.vec) for r in again.collect()} == {r.aid: tuple(r.vec) for r in vectors.collect()}
