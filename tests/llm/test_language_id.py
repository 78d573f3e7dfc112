"""Language ID: held-out accuracy, rejection, vectors against a plain count."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionrec.llm import language_id as li
from sessionrec.llm.registry import queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op5_language_id"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]
    assert (got.held_out == held).all()
    assert (got.lang_pred == docs.lang[got.index])[held].mean() >= 0.99
    assert got.score.between(0, 1).all() and not got.rejected.any()


def test_counts_are_those_of_ngrams():
    text = "Abc, déf  gh1i"
    counts = li.ngram_counts(text, 1 << 20)
    padded = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    grams = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    assert sorted(counts[counts > 0]) == sorted(grams.values())


def test_parts_do_not_change_counts(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abc é1.\n") for _ in range(400))
    whole = li.ngram_counts(text)
    for part in (1, 2, 7, 50):
        monkeypatch.setattr(li, "PART", part)
        cut = li.ngram_counts(text)
        # n-grams at a border are counted once
        assert abs(int(cut.sum()) - int(whole.sum())) <= 3 * (400 // part + 1)


def test_weights():
    counts = np.array([[1, 0, 3], [0, 0, 0]])
    got = li.weigh(counts, np.array([1.0, 2.0, 0.5], np.float32))
    want = np.array([1.0, 0, (1 + math.log(3)) / 2])
    assert got[0] == pytest.approx(want / np.linalg.norm(want)) and not got[1].any()


def test_cases(spark):
    rows = [(i, f"der die das und nicht {i}", "de") for i in range(30)]
    rows += [(i, f"the and of to not {i}", "en") for i in range(30, 60)]
    rows += [(60, None, "en"), (61, "", "en"), (62, "12 .. 34", None), (63, "漢字かな", None), (None, "the and", "en")]
    rows += [(5, rows[5][1], "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = li.identify(docs, li.learned(docs)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[i].lang_pred == "de" for i in range(30)) and all(by_id[i].lang_pred == "en" for i in range(30, 60))
    for i in (60, 61, 62):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0, True)
    assert by_id[63].rejected and by_id[63].lang_pred in ("de", "en")
    assert by_id[None].lang_pred == "en"
    empty = docs.limit(0)
    assert li.identify(empty, li.learned(empty)).count() == 0
    none = li.learned(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in li.identify(docs, none).collect()} == {"und"}


def test_sample_vectors_leave_in_small_batches():
    """Ids and counts of a whole sample in one batch are never Python objects at once."""
    import pyarrow as pa

    texts = [None if i % 7 == 0 else f"word {'abc'[i % 3] * (i % 5 + 1)} of row {i}" for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 300, "text": texts, "_order": list(range(300))})
    out = list(li._counter(64)([batch, batch.slice(0, 0), batch.slice(0, 1)]))
    assert max(b.num_rows for b in out) <= li.ROWS
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["order"] for r in rows] == [i for i in range(300) if i % 7]
    for row in rows:
        counts = li.ngram_counts(texts[row["order"]], 64)
        assert row["at"] == np.flatnonzero(counts).tolist() and row["values"] == counts[counts > 0].tolist()
