"""Filter audit against a brute-force replay of every order."""

from itertools import permutations

from sessionrec.llm import filter_audit as fa
from sessionrec.llm.sketch import Sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, first long, h long"
LABELS = "doc_id long, quality int, toxic int"


def audit(spark, docs, labels):
    table = spark.createDataFrame([(*d, 7, 8, 9) for d in docs], DOCS)
    masks = fa.document_masks(table)
    counts = fa.mask_counts(masks, spark.createDataFrame(labels, LABELS))
    return masks, {(r.part, r.filter_order, r.step): r for r in fa.audit(counts).collect()}


def fails(doc, docs):
    text = doc[1] or ""
    words = text.split()
    earlier = [d for d in docs if (d[1] or "") == text and d[0] is not None and (doc[0] is None or d[0] < doc[0])]
    found = [
        len(words) < 50, 100 * len(set(words)) < 65 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), bool(earlier),
    ]
    return {f for f, x in zip("ABCDE", found) if x}


def brute(docs, labels):
    labels = [x for x in labels if x[0] is not None]
    out, good, toxic = {}, {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    for part in {d[3] or "" for d in docs}:
        own = [(d[0], fails(d, docs)) for d in docs if (d[3] or "") == part]
        removed_by = {}
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                out[part, order, step] = (
                    len(left), len(gone), redundant, sum(x[1] == {f} for x in own),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                )
                removed_by[f] = removed_by.get(f, 0) + len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step] += (removed_by[f],)
    return out


def test_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, long, "en", "a", 1), (2, long, "en", "b", 1), (3, long, "en", None, 1), (3, long, "en", "", 1),
        (4, None, "en", "a", None), (5, "", None, "a", 0), (6, "X Y # same same", "en", "b", 1),
        (7, "word " * 100, "en", "b", 1), (None, long, "en", "b", 1), (None, "only here", "en", "b", 1),
        (None, "only here", "en", "b", 1), (8, "A" * 300_000 + " é |", "en", "a", 1), (9, long + "\x0b\x0c", "en", "a", 1),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (4, None, 1), (6, 1, None), (99, 1, 1), (None, 1, 1)]
    masks, got = audit(spark, docs, labels)
    assert masks.columns == ["doc_id", "part", "mask"] and masks.count() == len(docs)
    want = brute(docs, labels)
    assert len(got) == 600 * 3 and got.keys() == want.keys()
    for key, values in want.items():
        r = got[key]
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == values, key


def test_empty(spark):
    _, got = audit(spark, [], [])
    assert got == {}


def test_sketch_never_underestimates(spark):
    keys = [i % 50 - 25 for i in range(70)] + list(range(1000, 1200)) + [-(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in [*keys, None, None]], "k long").repartition(5)
    for rows_of_probes in (True, False):
        sketch = Sketch(len(keys), rows=rows_of_probes)
        sketch.width = sketch.size = 64  # far too small: collisions are certain
        sketch.size = 64 * (2 if rows_of_probes else 1)
        marked = rows.withColumn("r", sketch.repeated(rows, sketch.build(rows, "k"))("k")).collect()
        assert all(r.r for r in marked if r.k is not None and keys.count(r.k) > 1)
        wide = Sketch(len(keys), rows=rows_of_probes)
        marked = rows.withColumn("r", wide.repeated(rows, wide.build(rows, "k"))("k")).collect()
        assert all(r.r == (keys.count(r.k) > 1) for r in marked if r.k is not None)
        assert not any(r.r for r in marked if r.k is None)
