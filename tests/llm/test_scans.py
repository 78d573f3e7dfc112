"""Secret and license scans against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest

from sessionrec.llm import license_scan as ls
from sessionrec.llm import secret_scan as ss
from sessionrec.llm.registry import queries

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_words(text):
    text = "".join(c.lower() if c in LETTERS else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_dense(text, window, least):
    flagged = [
        -sum(c / window * math.log2(c / window) for c in Counter(text[i : i + window]).values()) >= least - 1e-9
        for i in range(max(0, len(text) - window + 1))
    ]
    inside = [any(flagged[max(0, p - window + 1) : p + 1]) for p in range(len(text))]
    # spans of overlapping or touching windows
    spans, at = [], 0
    while at < len(text):
        if inside[at]:
            end = at
            while end < len(text) and inside[end]:
                end += 1
            spans.append((at, end))
            at = end
        else:
            at += 1
    return spans


def test_dense_spans_match_recount():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("ab12cdefXYZ"[: rnd.randint(1, 11)]) for _ in range(rnd.randint(0, 60)))
        window = rnd.choice([1, 2, 5, 20])
        least = rnd.choice([0.0, 0.5, 1.3, 2.1, 3.05])
        assert ss.dense_spans(text, window, least) == brute_dense(text, window, least)


def brute_base(text):
    found = []
    key = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(key + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(found)]


CASES = [
    None,
    "",
    "token=token:abcdefgh",
    "PassWord: 'abc123'",
    "api_key==x1",
    "paſſword=abcdefgh",
    "AKIA" + "A1" * 8,
    "AKIAAKIA" + "B" * 15,
    "0123456789abcdef01234567",
    "é🙂 secret=aaaaaa tail deadbeef" + "f" * 30,
    "Zq3xT9bLw7VnR2kPd8Ys5Hm1",
    "EXAMPLEZq3xT9bLw7VnR2kPd8Ys5Hm1",
    "thisisjustaverylongwordwithoutanydigits",
    "x" * 200_000 + " password=hunter2222 " + "y" * 200_000,
]


def test_base_spans():
    for text in CASES:
        assert ss.Scanner().ordered(ss.base_spans(text or "")) == brute_base(text or "")


KEY = "Zq3xT9bLw7VnR2kPd8Ys5Hm1"


@pytest.mark.parametrize(
    "text, start, end",
    [
        (KEY, 0, 24),
        (f"/example/path={KEY}", 8, 38),  # words and separators that share a window with the key stay in its span
        (f"demo_example_id={KEY}", 15, 40),
        (f"{KEY}/your_api_key", 0, 25),
        ("qWzRkTpLmXvBnHdJfGsYcD", 0, 22),  # no digit, but no words either
        (f"1234567890={KEY}", 10, 35),
    ],
)
def test_keys_beside_allowed_words_are_found(text, start, end):
    assert ss.Scanner().entropy_spans(text) == [(start, "entropy_base64", end)]


@pytest.mark.parametrize(
    "text",
    [
        "getUserNameFromDatabaseByPublicKey", "the/quick/brown/fox/jumps/over/lazy/dogs", "QUICKBROWNFOXJUMPSOVERLAZYDOGS",
        f"EXAMPLE{KEY}", f"{KEY}_placeholder", "92837465019283746501928374", "some-long_words-with_separators_and_hyphens",
        "(" * 50 + "a" * 100_000,
    ],
)
def test_words_and_placeholders_are_left_alone(text):
    assert not ss.Scanner().entropy_spans(text)


def brute_scan(text):
    """Entropy spans by recounting every window, cut at placeholder parts."""
    found = []
    for c in ss.CLASSES:
        for run in re.finditer(f"[{c.characters}]+", text):
            cut = [False] * len(run[0])
            for part in re.finditer("[^/=]+", run[0]):
                if any(re.search(p, part[0]) for p in ss.PLACEHOLDERS):
                    cut[part.start() : part.end()] = [True] * len(part[0])
            at = 0
            for held, group in itertools.groupby(cut):
                size = len(list(group))
                piece = "" if held else run[0][at : at + size]
                for a, b in brute_dense(piece, c.window, c.least):
                    if not any(re.fullmatch(p, piece[a:b]) for p in ss.ALLOWED):
                        found.append((run.start() + at + a, c.kind, run.start() + at + b))
                at += size
    return sorted(found)


def test_entropy_spans_against_recount():
    rnd = random.Random(8)
    parts = [KEY, "example", "path", "0" * 9, "deadbeef0123", "=", "/", " ", "_", "1234567890", "camelCaseWord", "é", "9f86d081884c7d659a2feaa0"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert sorted(ss.Scanner().entropy_spans(text)) == brute_scan(text)


def test_scan_frame(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(CASES)] + [(None, "secret=abcdefg", 1)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in ss.scan(docs).collect()}
    for i, text in enumerate(CASES):
        base = brute_base(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert rows[i].n_assign == sum(k == "assign" for _, k, _ in base)
        assert set(listed.split(",")) <= set(rows[i].spans.split(",")) or not base
    assert rows[None].n_assign == 1
    assert rows[10].n_entropy == 1 and rows[11].n_entropy == 0 and rows[12].n_entropy == 0
    assert ss.scan(docs.limit(0)).count() == 0


def test_secret_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = {r.doc_id: r for r in queries()["op2_secret_scan"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        base = brute_base(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert rows[doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        kinds = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
        spans = sorted(base + brute_scan(text or ""), key=lambda s: (s[0], kinds.index(s[1]), s[2]))
        assert rows[doc_id].spans == ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def brute_license(text, templates, phrases, threshold, block, stride):
    words = brute_words(text)
    places = []
    for phrase, label in phrases.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    labels, best = {label for _, label in places}, 0.0
    for label, template in templates:
        t = set(brute_words(template))
        others = {w for other, x in templates if other != label for w in brute_words(x)}
        own = t - others if len(t) <= ls.SHORT else set()
        size, step = block, stride
        if len(brute_words(template)) > block - stride:
            step = next(2**k for k in range(20) if 2**k >= len(brute_words(template)))
            size = 2 * step
        for start in range(0, max(1, len(words) - step), step):
            held = set(words[start : start + size])
            if len(t & held) / len(t) >= threshold - 1e-12 and own <= held:
                labels.add(label)
                best = max(best, len(t & held) / len(t))
    return (
        len(words),
        len(places),
        min((p for p, _ in places), default=None),
        max((p for p, _ in places), default=None),
        ",".join(sorted({label for _, label in places})),
        ",".join(sorted(labels)),
        1.0 if places else best,
    )


def as_tuple(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_license_join_against_brute_force(spark, threshold):
    rnd = random.Random(4)
    templates = [("x", "a b c d e"), ("y", "d e f g h i"), ("z", "a a q")]
    phrases = {"a b": "ab", "c c c": "ccc"}
    texts = [None, "", "A B", "c c c c", "cc by"] + [
        " ".join(rnd.choice("abcdefghijklmnq") for _ in range(rnd.randint(0, 40))) for _ in range(80)
    ]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(3, texts[3], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = ls.license_scan(docs, templates, phrases, threshold, 8, 4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert as_tuple(r) == pytest.approx(brute_license(texts[r.doc_id], templates, phrases, threshold, 8, 4))
    assert ls.license_scan(docs.limit(0)).count() == 0


def test_long_templates_are_found_wherever_they_stand(spark):
    long = " ".join(f"clause{i}" for i in range(90))
    templates = [*ls.TEMPLATES, ("long", long)]
    texts = [long] + [" ".join(["filler"] * n) + " " + long + " end" * 40 for n in (1, 37, 64, 100, 127, 200_000)]
    texts += [" ".join(long.split()[:60]), "released under the gpl license", "Released under the MIT license."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in ls.license_scan(docs, templates).collect()}
    assert [got[i] for i in range(10)] == [("long", 1.0)] * 7 + [("", 0.0), ("", 0.0), ("mit", 1.0)]


def test_license_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    got = queries()["op4_license_scan"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_license(docs[r.doc_id], ls.TEMPLATES, ls.PHRASES, ls.THRESHOLD, ls.BLOCK, ls.STRIDE)
        assert as_tuple(r) == pytest.approx(want)
