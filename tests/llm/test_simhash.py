"""SimHash: fingerprints, filter and components against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sessionrec.llm import simhash as sh
from sessionrec.llm.components import components
from sessionrec.llm.registry import queries


def brute_fingerprint(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def unsigned(x):
    return x & (2**64 - 1)


def test_fingerprints():
    for text in ["", "  ", "One", "One two", "A b C", "É a B c d", "a b c a b c " * 50, "x\ty\nz w"]:
        assert unsigned(sh.fingerprint(text)) == brute_fingerprint(text)


@pytest.mark.parametrize("paired,segments,distance", [(64, 4, 2), (1, 4, 2), (2, 5, 2), (1, 4, 1), (64, 3, 1)])
def test_links_keep_every_component(spark, paired, segments, distance):
    rnd = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        values.add(centre)
        for _ in range(12):
            v = centre
            for _ in range(rnd.randint(0, 5)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    values |= {0, 1, 3, 7, 2**63, 2**63 + 2**62}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = components(sh.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, segments, paired))
    got = {r.node: r.component for r in found.collect()}
    linked = [(a, b) for a in signed for b in signed if a < b and (unsigned(a) ^ unsigned(b)).bit_count() <= distance]
    want = brute_components(signed, linked)
    assert {n: got.get(n, n) for n in signed} == want


def test_chain_test_loses_no_pair(spark):
    rnd = random.Random(1)
    rows = [(sum(1 << b for b in rnd.sample(range(64), k)) - 2**63,) for k in (0, 1, 2, 2, 2, 2) for _ in range(50)]
    rows = [(r[0] + 2**63 if r[0] + 2**63 < 2**63 else r[0] + 2**63 - 2**64,) for r in rows]
    df = spark.createDataFrame(rows, "x long")
    for m in (3, 4, 5, 8):
        assert df.filter(~sh.chain_test(F.col("x"), 2, m)).count() == 0


def test_path_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (1, 0), (100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links.repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_nulls_repeats_and_empty(spark):
    rows = [(3, None, 1), (2, "", 2), (None, "a b c d", 3), (7, "A b c d", 4), (7, "a b c d", 5), (None, "q", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted(((r.doc_id, r.component_id) for r in sh.simhash_components(docs).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (None, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert sh.simhash_components(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    got = queries()["op6_simhash"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fps = {d: brute_fingerprint(t) for d, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got.fingerprint)) == {d: f"{v:016x}" for d, v in fps.items()}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(list(fps), linked)
