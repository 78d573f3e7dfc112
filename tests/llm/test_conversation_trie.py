"""Prefix trie against a brute-force trie of tuples."""

import hashlib
import zlib

import pytest

from sessionrec.functions import order
from sessionrec.llm import conversation_trie as ct

ROWS = "conv_id long, turn long, role string, text string, depth int, digest int"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path)))
    out = []
    for node, who in members.items():
        inside = [x for x in members if x[: len(node)] == node]
        children = [x for x in inside if len(x) == len(node) + 1]
        leaves = [x for x in inside if all(n == len(x) for _, n in members[x])]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in inside)
        ends = ",".join(str(c) for c, n in sorted(who) if n == len(node))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append(
            (min(c for c, _ in who), len(node), parent, len(who), len(children), len(leaves), saved,
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def run(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], ROWS)
    return sorted((tuple(r) for r in ct.trie(table).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    found = []
    for c in [*range(0, 14), 100, 101, 102, 205, 307, -3, -100, -101]:
        for t in range(c % 7):
            found.append((c, t, "user" if t % 2 == 0 else None, f"text {t % 3} of {c % 2}" if t != 4 else None))
    found += [(1, None, "user", "first"), (2, 1, "user", "same turn"), (2, 1, "user", "same turn"), (None, 1, "a", "b")]
    found += [(40, t, "user", f"turn {t}") for t in range(30)] + [(41, t, "user", f"turn {t}") for t in range(30)]
    found += [(50, 0, "user", "x" * 300_000), (51, 0, "user", "é\U0001f600"), (60, 0, None, None)]
    return found


def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_crowded_sketch_and_long_conversations(spark, rows, monkeypatch):
    class Small(ct.Sketch):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            self.width, self.size = 16, 32

    monkeypatch.setattr(ct, "Sketch", Small)
    monkeypatch.setattr(ct, "hot_groups", lambda df, keys: order.hot_groups(df, keys, 5))
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
