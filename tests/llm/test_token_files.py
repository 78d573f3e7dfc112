"""Token files and the coder: round trips, damage, order; packing against piece by piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionrec.llm import id_coder, packing
from sessionrec.llm import token_files as tf
from sessionrec.llm.registry import queries
from sessionrec.llm.tokens import WordTokenizer


def library(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block,lanes", [(4096, 1024), (64, 3), (1, 5)])
def test_coder_round_trip(block, lanes):
    rng = np.random.default_rng(1)
    for ids in ([], [0], [65535] * 70, list(range(200)), rng.integers(0, 65536, 500), rng.zipf(1.4, 900) % 49408):
        coded = id_coder.encode(np.array(ids, np.int64), block, lanes)
        assert id_coder.decode(coded, lanes).tolist() == list(ids)


def test_coder_gains_and_damage():
    ids = np.tile(np.arange(100), 60)
    coded = id_coder.encode(ids)
    assert len(coded) < len(ids)  # 8 bits an id at most, against 16 plain
    for at in (2, 20, 40, len(coded) - 3):
        broken = bytearray(coded)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            id_coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        id_coder.decode(coded[:-1])
    with pytest.raises(ValueError):
        id_coder.encode(np.array([65536]))


def test_words_equal_the_library():
    rnd = random.Random(3)
    alphabet = list("aàbcdeéz ABCÉÎ'  \n\t\r\x0b\x1c\x85\xa0 ,.!1²½ßµªº·ĀğİŠẞ漢🙂éΣς_-'sst're<|>")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "x" * 30_000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        words = WordTokenizer(public_tokenizers.path(name))
        t = words.tokenizer
        for text in texts:
            assert np.frombuffer(words.packed(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_files_nulls_and_order(spark, tmp_path):
    rows = [(5, "b c", 1), (None, None, 2), (2, "hello hello", 3), (5, "a", 4), (5, "a", 5), (9, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    path = tf.write_files(docs, str(tmp_path / "files"), file_ids=3)
    got = tf.read_files(spark, path).join(tf.file_starts(spark, path), ["part", "seq"])
    got = sorted(got.collect(), key=lambda r: r.first + r.before)
    assert [r.doc_id for r in got] == [None, 2, 5, 5, 5, 9]
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.first + r.before for r in got] == starts[:-1].tolist()
    for r in got:
        texts = [t for d, t, _ in rows if d == r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() in [library(tf.VOCABULARY, t) + [1] for t in texts]
    assert tf.read_files(spark, tf.write_files(docs.limit(0), str(tmp_path / "none"))).count() == 0


def test_file_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = {r.doc_id: r for r in queries()["op8_token_files"](spark, sf).collect()}
    start = 0
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def piece_by_piece(lengths, limits):
    bins = []
    for length in sorted(lengths, reverse=True):
        need = packing.needs(length)
        fits = [b for b in bins if packing.room_for(b[0], need)]
        if fits:
            best = min(fits, key=lambda b: packing.score(b[0], need, limits))
        else:
            best = [limits.whole(), []]
            bins.append(best)
        best[0] = tuple(a - b for a, b in zip(best[0], need))
        best[1].append(length)
    return bins


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 5, 1500, (1, 1, 1)), packing.Limits(64, 64, 4096, rule="dot")])
def test_plan_equals_piece_by_piece(limits):
    rnd = random.Random(6)
    for _ in range(20):
        lengths = [rnd.randint(1, 38) for _ in range(rnd.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        bins = packing.plan(histogram, limits)
        placed = sorted(n for b in bins for length, k, _ in b.placed for n in [length] * k * b.count)
        assert placed == sorted(lengths)
        for b in bins:
            used = [sum(k * packing.needs(n)[i] for n, k, _ in b.placed) for i in range(3)]
            assert all(u <= w for u, w in zip(used, limits.whole()))
        if limits.rule == "norm":
            assert sum(b.count for b in bins) == len(piece_by_piece(lengths, limits))


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc_id, text in docs:
        ids = library(packing.VOCABULARY, text) + [2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == capacity for r in pieces[1:])
        at = 0
        for r in pieces:
            part = ids[at : at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_packing_query(spark, sf):
    rows = queries()["op7_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sequences = check_packing(rows, docs, 1024)
    assert sequences <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_packing_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "word " * 3000, 3), (4, "one two", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check_packing(packing.pack(docs).collect(), [r[:2] for r in rows], 1024)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs.filter("doc_id = 4").union(docs.filter("doc_id = 4"))).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, twice[0].length}
    assert packing.pack(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")).count() == 6


@pytest.mark.parametrize("name", ("byte_bpe_50k.json", "word_bpe_49k.json"))
def test_latin_texts_are_split_by_the_standard_library_alike(name):
    import random

    import public_tokenizers

    from sessionrec.llm import tokens

    words = tokens.WordTokenizer(public_tokenizers.path(name))
    draw = random.Random(3)
    letters = [chr(c) for c in range(0x250)] + list(" \n\t'std ") * 30
    for _ in range(4000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 14)))
        assert words.latin.findall(text) == words.pattern.findall(text), text
    words.pattern = None  # not used for a Latin text
    assert words.packed("É' a  b’s"[:6]) and words.packed("plain  text\n")


def test_words_of_one_task_stay_in_the_cache():
    """A task reads 16 MB of text, of which about 300,000 words are new: each is encoded once."""
    from sessionrec.llm import tokens

    class Library:
        calls = 0

        def encode(self, word, add_special_tokens):
            Library.calls += 1
            return self

        ids = (1,)

    words = tokens._Words(Library())
    for _ in range(2):
        for n in range(300_000):
            words[str(n)]
    assert Library.calls == 300_000
