"""Fuzzy line dedup against all-pairs comparison."""

import random

from sessionrec.llm import line_dedup as ld
from sessionrec.llm.registry import queries


def brute(rows, similarity=0.8, width=7, least=7):
    """Kept line numbers of each (doc_id, text) row by similarity alone; ids not null."""
    first = {}
    for doc_id, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                first[line] = min(first.get(line, (doc_id, n)), (doc_id, n))
    lines = sorted(first)
    label = {x: x for x in lines}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = {x: {x[i : i + width] for i in range(len(x) - width + 1)} for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                    label[find(a)] = find(b)
    stays = {}
    for x in lines:
        stays[find(x)] = min(stays.get(find(x), first[x]), first[x])
    return [
        [n for n, line in enumerate((text or "").split("\n")) if len(line) < least or stays[find(line)] == (doc_id, n)]
        for doc_id, text in rows
    ]


def variants(rnd, count, edits):
    base = "".join(rnd.choice("abcdefghij klmno") for _ in range(200))
    out = [base]
    for _ in range(count):
        line = list(base)
        for _ in range(rnd.randint(0, edits)):
            line[rnd.randrange(len(line))] = rnd.choice("XYZ")
        out.append("".join(line))
    return out


def kept_lines(spark, docs, **options):
    rows = ld.LineDedup(**options).dropped(docs).collect()
    return {(r.doc_id, r.body): set(r.dropped) for r in rows}


def test_signature_estimates_similarity():
    rnd = random.Random(3)
    a, b = variants(rnd, 1, 3)
    far = "".join(rnd.choice("abcdefghij klmno") for _ in range(300))
    sig = ld.signatures([a, b, far], 7, 512)
    assert abs((sig[0] == sig[1]).mean() - ld.jaccard(a, b)) < 0.08
    assert (sig[0] == sig[2]).mean() < 0.05
    # a line's signature does not depend on its neighbours
    assert (ld.signatures([far, a], 7, 512)[1] == sig[0]).all()


def test_nulls_repeats_extra_columns(spark):
    line = "the same line of enough characters"
    rows = [
        (5, f"{line}\nshort", 1, "x"),
        (2, f"\n{line}\n", 2, "x"),
        (None, line, 3, "x"),
        (7, None, 4, None),
        (8, "", 5, "x"),
        (2, f"\n{line}\n", 6, "x"),
        (9, f"{line}\n{line}", 7, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int, h1 string")
    out = {r.number: r for r in ld.LineDedup().dedup_text(docs).collect()}
    assert [out[i].text for i in range(1, 8)] == ["short", f"\n{line}\n", "", None, "", f"\n{line}\n", ""]
    assert out[4].h1 is None and set(docs.columns) == set(out[1].asDict())
    assert ld.LineDedup().dedup_text(docs.limit(0)).count() == 0


def test_long_line(spark):
    rnd = random.Random(1)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(300_000))
    docs = spark.createDataFrame([(1, line), (2, line + "tail"), (3, line[::-1])], "doc_id long, text string")
    assert {r.doc_id: r.text for r in ld.LineDedup().dedup_text(docs).collect()} == {1: line, 2: "", 3: line[::-1]}


def test_short_lines_take_part(spark):
    rows = [
        (1, "Les.\n短い文です。\n\nabcdefgh ijklmno"),
        (2, "Les.\n \t\n短い文です。\nabcdefgh ijklmnp"),
        (3, "Les\n\n\u3000\nabcdefgh ijklmno\nLes."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r.doc_id: r.dropped for r in ld.LineDedup(bands=24, band_rows=2).dropped(docs).collect()}
    # the changed last line shares 9 of 11 shingles
    assert dropped == {2: [0, 2, 3], 3: [3, 4]}


def brute_all(rows):
    """Kept line numbers when every line takes part: under 7 characters by equality."""
    kept = [set(keep) for keep in brute(rows)]
    seen = set()
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        for n, line in enumerate((rows[i][1] or "").split("\n")):
            if line.strip() and len(line) < 7:
                kept[i] -= {n} if line in seen else set()
                seen.add(line)
    return [sorted(keep) for keep in kept]


def test_groups_of_all_lines_against_all_pairs(spark):
    rnd = random.Random(8)
    lines = [x for _ in range(6) for x in variants(rnd, 14, 5)] + ["short", "", "short"]
    lines += [x[:15] for x in variants(rnd, 40, 3)]
    rnd.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ld.LineDedup(bands=24, band_rows=2).dedup_text(docs).collect()
    want = {r[0]: "\n".join(r[1].split("\n")[n] for n in keep) for r, keep in zip(rows, brute_all(rows))}
    assert {r.doc_id: r.text for r in out} == want


def test_query_all_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    got = {r.doc_id: r.dropped for r in queries()["op10_line_dedup"](spark, sf).collect()}
    same = short = 0
    for (doc_id, text), keep in zip(rows, brute_all(rows)):
        lines = (text or "").split("\n")
        gone = sorted(set(range(len(lines))) - set(keep))
        same += got[doc_id] == ",".join(map(str, gone))
        short += sum(len(lines[n]) < 20 for n in gone)
    assert same >= 0.99 * len(rows) and short > 0
