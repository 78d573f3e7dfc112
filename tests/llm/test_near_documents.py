"""Near-duplicate documents against all pairs."""

import random
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).parent
sys.path[:0] = [str(HERE), str(HERE.parents[1])]

import corpus_pipeline as cp  # noqa: E402
from test_simhash import brute_components  # noqa: E402

from sessionrec.llm import near_documents as nd  # noqa: E402
from sessionrec.llm.simhash import fingerprint  # noqa: E402


def word_shingles(text):
    found = (text or "").lower().split()
    return {" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def similar_pairs(sets):
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4:
                common = len(x & y)
                if common * 5 >= (len(x) + len(y) - common) * 4:
                    yield a, b


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return " ".join(words)


def near_copies(groups, copies, seed=4):
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([3, 6, 12, 60, 300]))]
        rows += [edited(rnd, base[: rnd.randint(max(1, len(base) * 8 // 10), len(base))], rnd.randint(0, 1 + len(base) // 40)) for _ in range(copies)]
    rnd.shuffle(rows)
    return [(i, t) for i, t in enumerate([*rows, "", None, "  ", "one two", "One two"])]


@pytest.mark.parametrize("paired", [64, 3])
def test_groups_against_all_pairs(spark, paired):
    rows = near_copies(40, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in nd.NearDocuments(paired=paired).groups(docs).collect()}
    sets = {i: word_shingles(t) for i, t in rows}
    linked = [*similar_pairs(sets), *[(a, b) for a in sets for b in sets if a < b and not sets[a] and not sets[b]]]
    assert len({min(x) for x in linked}) > 40 and got == brute_components(sorted(sets), linked)


def test_odd_tables(spark):
    """Empty, repeated rows, null ids, very long texts, and columns with the join's own names."""
    schema = "doc_id long, text string, node string, component_id string, n int, h int, star int"
    empty = spark.createDataFrame([], schema)
    assert nd.NearDocuments().groups(empty).collect() == []
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(4, "a b c"), (4, "a b c"), (3, "A b  c"), (None, "a b c"), (None, "only here"), (8, long), (6, long + " end")]
    rows += [(9, ""), (2, None), (None, " ")]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], schema)
    got = sorted(((r.doc_id, r.component_id) for r in nd.NearDocuments().groups(docs).collect()), key=str)
    want = [(4, 3), (4, 3), (3, 3), (None, 3), (None, None), (8, 6), (6, 6), (9, 2), (2, 2), (None, 2)]
    assert got == sorted(want, key=str)


def test_stage_removes_near_copies_far_in_simhash(spark, sf):
    """Copies with three of 200 words changed go, however many SimHash bits differ."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    base_text = " ".join(base)
    rows = [(1, base_text, "en", "s", 1)]
    rows += [(2 + i, edited(rnd, base, 3), "en", "s", 1) for i in range(6)]
    rows.append((90, edited(rnd, base, 60), "en", "s", 1))
    assert max((fingerprint(r[1]) ^ fingerprint(base_text)).bit_count() for r in rows[1:7]) > 2
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    kept = dict(cp.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, schema), sf)
    sets = {r[0]: word_shingles(r[1]) for r in rows}
    label = brute_components(sorted(sets), list(similar_pairs(sets)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values())) == [1, 90]
