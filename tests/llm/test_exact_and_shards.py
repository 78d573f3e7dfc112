"""Exact dedup, ring shards and decontamination against brute force and SQL."""

import hashlib
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionrec.llm import decontamination as dc
from sessionrec.llm import exact_dedup as ed
from sessionrec.llm import ring_sharding as rs
from sessionrec.llm.registry import oracle_sql, queries

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import connect, differences  # noqa: E402


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op9_decontamination"])
def test_same_as_sql(spark, sf, name):
    got = queries()[name](spark, sf).toPandas()
    assert differences(got, connect(sf).execute(oracle_sql()[name]).df()) is None


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return sorted(
        (
            (d, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items()
            for d in ids
        ),
        key=str,
    )


@pytest.mark.parametrize("number", [ed.chunk_number, lambda c: F.xxhash64(c) % 3, lambda c: F.lit(1).cast("bigint")])
def test_recipes_are_exact_for_any_numbers(spark, number):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("ab. \n") for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(i + 1000, t) for i, t in rows[::3]] + [(None, rows[4][1]), (None, "only here"), (7, rows[7][1]), (5000, None)]
    rows += [(6000, "no sentence end " * 3000), (6001, "no sentence end " * 3000), (6002, "é" * 9000), (6003, " \t\n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, numbers int")
    out = ed.exact_dedup(docs, number, 4, 16).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == brute_exact(rows)
    kept = [r.text_sha256 for r in out if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert ed.exact_dedup(docs.limit(0)).count() == 0


def test_chunks_join_to_the_text_and_resist_shifts(spark):
    text = " ".join(f"word{i % 37}{'.' if i % 11 == 0 else ''}" for i in range(4000)) + "x" * 20_000
    df = spark.createDataFrame([(text,), ("inserted " + text,)], "text string")
    a, b = (r.c for r in df.select(ed.chunks(F.col("text")).alias("c")).collect())
    assert "".join(a) == text and max(map(len, a)) <= ed.MAX_CHUNK
    assert len(set(a) & set(b)) > len(a) // 2


def brute_ring(keys, shards, vnodes):
    """Shard of each key in ring order, one key at a time."""
    points = rs.ring_points(shards, vnodes)
    bounds = rs.row_bounds(len(keys), shards)
    first = lambda p: next((i for i, (q, _) in enumerate(points) if q >= p), 0)
    places = []
    for k in keys:
        p = int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16)
        arc = first(p)
        places.append((arc, (p - points[arc - 1][0]) % rs.RING, k))
    out, used = {}, [0] * shards
    for arc, _, k in sorted(places):
        at = arc
        while used[points[at % len(points)][1]] >= bounds[points[at % len(points)][1]]:
            at += 1
        shard = points[at % len(points)][1]
        out[k] = (shard, used[shard], points[arc][1])
        used[shard] += 1
    return out


@pytest.mark.parametrize("n,vnodes,slice_rows", [(101, 1, 7), (200, 16, 3), (5, 8, 1000)])
def test_ring_one_key_at_a_time(spark, n, vnodes, slice_rows):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"), F.lit(1).alias("shard"))
    got = {r.doc_id: (r.shard, r.slot, r.home_shard) for r in rs.ring_shards(docs, 4, vnodes, slice_rows).collect()}
    assert got == brute_ring(range(n), 4, vnodes)


def test_shard_query_and_cases(spark, sf):
    got = queries()["op3_ring_sharding"](spark, sf).toPandas()
    assert got.doc_id.is_unique and set(got.law) == {"rows"}
    sizes = got.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    assert sizes["size"].max() - sizes["size"].min() <= 1 and len(sizes) == 8
    assert (sizes["max"] == sizes["size"] - 1).all() and (sizes["nunique"] == sizes["size"]).all()
    docs = spark.createDataFrame(
        [(1, None), (None, None), (None, "é"), (2, "é"), (2, "é")], "doc_id long, text string"
    )
    rows = rs.ring_shards(docs, 2).collect()
    assert sorted(r.size for r in rows) == [1, 1, 3, 3, 3] and len({(r.shard, r.slot) for r in rows}) == 5
    assert rs.ring_shards(docs.limit(0)).count() == 0


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    before, after = (
        {r.doc_id: r.shard for r in rs.ring_shards(docs, n).collect()} for n in (8, 9)
    )
    assert sum(before[k] != after[k] for k in before) < 4000 * 0.3


def brute_hits(docs, items, window, slop=0):
    out = []
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault("" if item is None else str(item), set()).add(tuple(w[i : i + window]))
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for item, found in phrases.items():
            for p in found:
                for i in range(len(w) - len(p) + 1):
                    near = all(p[k] in w[max(0, i + k - slop) : i + k + slop + 1] for k in range(len(p)))
                    if near:
                        hit |= set(range(i, i + len(p)))
                        names.add(item)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,segment,block,slop", [(10, 400_000, 200_000, 0), (3, 40, 12, 0), (3, 25, 200, 1), (2, 60, 9, 2)])
def test_index_against_brute_force(spark, window, segment, block, slop):
    rnd = random.Random(window + segment)
    say = lambda n: " ".join(rnd.choice(["a", "B", "c", "d9", "é", "f"]) for _ in range(n))
    docs = [(i, say(rnd.randint(0, 40))) for i in range(40)] + [(3, "a b c"), (None, "a B c"), (99, None)]
    items = [(i, say(rnd.randint(0, 14))) for i in range(8)] + [(7, "zz a b"), (None, "c d9"), (8, None), (9, "")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, terms string")
    got = dc.decontaminate(frame, bench, window, slop, segment, block).drop("row").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(docs, items, window, slop)
    assert dc.decontaminate(frame.limit(0), bench, window).count() == 0
    assert {r.n_hit for r in dc.decontaminate(frame, bench.limit(0), window).collect()} == {0}
