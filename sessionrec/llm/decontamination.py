"""Benchmark decontamination by a distributed positional inverted index.

The index is stored in segments, each over some hundred thousand words of consecutive
documents: sorted posting lists of word positions, for the words that the test set uses
at all. Segments are independent, so building and searching need no shuffle and a lost
executor repeats only its own segments. Term frequencies are summed over all segments.
A search takes the posting list of a phrase's rarest term, and intersects it with the
lists of the next rarest ones, each shifted by the term's offset in the phrase. With a
slop of zero what is left are the exact places; otherwise each term may stand up to
``slop`` words from its place.

The test set is searched in blocks of at most ``BLOCK_WORDS`` words, whose vocabulary and
phrases are all that is sent to every task; a larger test set takes more passes. A single
item longer than that is a block of its own.

Defined cases: null texts have no words; repeated items and items with the same id count
once; a null item_id is the empty string; an empty test set hits nothing; repeated
documents each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import alnum_words, documents, texts, with_rows
from sessionrec.sources.stages import materialize

WINDOW = 10
SEGMENT_WORDS = 400_000
BLOCK_WORDS = 200_000

INDEX_SCHEMA = (
    "rows array<bigint>, doc_ids array<bigint>, doc_ends array<bigint>, "
    "terms array<int>, ends array<bigint>, positions array<int>"
)
MATCH_SCHEMA = (
    "row long, doc_id long, n_words long, starts array<bigint>, stops array<bigint>, items array<string>"
)


def windows(words: list[bytes], length: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All runs of ``length`` consecutive words; all words if there are fewer."""
    if not words:
        return set()
    return {tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))}


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test set's (item id, words) in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = alnum_words(row["text"] or "")
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"] or "", words))
        size += len(words)
    yield block


def build_index(docs: DataFrame, vocabulary: list[bytes], segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per segment; ``docs`` has _row, doc_id and text."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def segment(rows, ids, ends, parts):
        terms = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.flatnonzero(terms >= 0)
        order = np.argsort(terms[at], kind="stable")
        found, counts = np.unique(terms[at], return_counts=True)
        lists = [rows, ids, ends, found.astype(np.int32), np.cumsum(counts), at[order].astype(np.int32)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        names = ["rows", "doc_ids", "doc_ends", "terms", "ends", "positions"]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                for x, kind in zip(lists, kinds)
            ],
            names,
        )

    def run(batches):
        rows, ids, ends, parts, size = [], [], [], [], 0
        get = number.get
        for batch in batches:
            for row, doc_id, text in zip(
                batch["_row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            ):
                words = alnum_words(text)
                parts.append(np.array([get(w, -1) for w in words], np.int32))
                size += len(words)
                rows.append(row)
                ids.append(doc_id)
                ends.append(size)
                if size >= segment_words:
                    yield segment(rows, ids, ends, parts)
                    rows, ids, ends, parts, size = [], [], [], [], 0
        if rows:
            yield segment(rows, ids, ends, parts)

    index = docs.select("_row", "doc_id", "text").mapInArrow(run, INDEX_SCHEMA)
    return materialize(index, "positional-index")


def term_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Places of each vocabulary term in the whole corpus."""
    ends = F.col("ends")
    counts = F.transform(
        ends, lambda e, i: e - F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
    )
    pairs = index.select(F.explode(F.arrays_zip("terms", counts.alias("counts"))).alias("t"))
    out = np.zeros(size, np.int64)
    # At most one row per vocabulary term of a block.
    for row in pairs.groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect():
        out[row["terms"]] = row["n"]
    return out


def search(index: DataFrame, phrases: list[tuple[list[int], str]], frequency: np.ndarray, slop: int = 0) -> DataFrame:
    """Matches of each document; phrases are (term numbers, item id).

    ``starts`` and ``stops`` are the word spans of the matches, in ascending order.
    """
    longest = max((len(p) for p, _ in phrases), default=1)
    terms = np.full((len(phrases), longest), -1, np.int64)
    offsets = np.zeros((len(phrases), longest), np.int64)
    for i, (phrase, _) in enumerate(phrases):
        order = sorted(range(len(phrase)), key=lambda k: (frequency[phrase[k]], phrase[k], k))
        terms[i, : len(order)] = [phrase[k] for k in order]
        offsets[i, : len(order)] = order
    lengths = np.array([len(p) for p, _ in phrases], np.int64)
    owners = sorted({item for _, item in phrases})
    place = {item: i for i, item in enumerate(owners)}
    owner = np.array([place[item] for _, item in phrases], np.int64)

    # Documents stand so far apart that no term is near one of another document.
    gap = 2 * slop + (slop > 0)

    def places(row):
        """(document ends, phrase, document, start in the segment) of all matches."""
        ends = np.asarray(row["doc_ends"], np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        held = np.asarray(row["terms"], np.int64)
        stops = np.asarray(row["ends"], np.int64)
        none = np.zeros(0, np.int64)
        if not len(held) or not len(phrases):
            return ends, none, none, none
        positions = np.asarray(row["positions"], np.int64)
        positions = positions + gap * np.searchsorted(ends, positions, side="right")
        counts = np.diff(stops, prepend=0)
        wide = int(ends[-1]) + gap * len(ends) + longest + 2 * slop + 2
        keys = np.repeat(held, counts) * wide + positions + slop
        # Rarest terms first: all places of each phrase's rarest term.
        slot = np.searchsorted(held, terms[:, 0])
        there = (slot < len(held)) & (held[np.minimum(slot, len(held) - 1)] == terms[:, 0])
        phrase = np.flatnonzero(there)
        n = counts[slot[phrase]]
        first = np.repeat(stops[slot[phrase]] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        phrase = np.repeat(phrase, n)
        start = positions[first] - offsets[phrase, 0]
        if slop:
            phrase, start = np.repeat(phrase, 2 * slop + 1), (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            phrase, start = np.unique(np.stack([phrase, start]), axis=1)
        inside = start >= 0
        phrase, start = phrase[inside], start[inside]
        for k in range(1, longest):
            want = terms[phrase, k]
            low = want * wide + start + offsets[phrase, k]  # slop words before the term's own place
            at = np.searchsorted(keys, low)
            ok = (want < 0) | ((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= low + 2 * slop))
            phrase, start = phrase[ok], start[ok]
        # A match must not reach over the ends of its document.
        doc = np.searchsorted(begins + gap * np.arange(len(ends)), start, side="right") - 1
        start = start - gap * doc
        ok = start + lengths[phrase] <= ends[doc]
        return ends, phrase[ok], doc[ok], start[ok]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one segment at a time, as arrays
                row = {name: batch[name][i].values for name in batch.schema.names}
                ends, phrase, doc, start = places(row)
                begins = np.concatenate([[0], ends[:-1]])
                order = np.lexsort((lengths[phrase], start))
                phrase, start, doc = phrase[order], start[order], doc[order]
                bound = np.searchsorted(doc, np.arange(len(ends) + 1))
                starts, stops, items = [], [], []
                for d in range(len(ends)):
                    a, b = bound[d], bound[d + 1]
                    starts.append((start[a:b] - begins[d]).tolist())
                    stops.append((start[a:b] + lengths[phrase[a:b]] - begins[d]).tolist())
                    items.append([owners[i] for i in np.unique(owner[phrase[a:b]])] if b > a else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        row["rows"],
                        row["doc_ids"],
                        pa.array(ends - begins, pa.int64()),
                        pa.array(starts, pa.list_(pa.int64())),
                        pa.array(stops, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["row", "doc_id", "n_words", "starts", "stops", "items"],
                )

    return index.mapInArrow(run, MATCH_SCHEMA)


def covered(starts: np.ndarray, stops: np.ndarray) -> int:
    """Words inside any of the spans."""
    if not len(starts):
        return 0
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    before = np.concatenate([[0], stops[:-1]])
    return int(np.maximum(0, stops - np.maximum(starts, before)).sum())


def _summaries(batches):
    for batch in batches:
        hit, count, digest = [], [], []
        for starts, stops, items in zip(batch["starts"], batch["stops"], batch["items"]):
            hit.append(covered(np.array(starts.as_py(), np.int64), np.array(stops.as_py(), np.int64)))
            names = sorted(set(items.as_py()))
            count.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["n_words"],
                pa.array(hit, pa.int64()),
                pa.array(count, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
                batch["row"],
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "row"],
        )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = 0,
    segment_words: int = SEGMENT_WORDS,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row of each document."""
    parts = blocks(benchmark, block_words)
    block, following = next(parts), next(parts, None)
    rows = texts(docs, id_col)
    if following is None:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    else:  # rows of several passes meet by number, so number them once
        rows = with_rows(rows, "documents")
    found = []
    while block is not None:
        vocabulary = sorted({w for _, words in block for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        phrases = [
            ([number[w] for w in phrase], item)
            for phrase, item in sorted({(p, item) for item, words in block for p in windows(words, window)})
        ]
        index = build_index(rows, vocabulary, segment_words)
        found.append(search(index, phrases, term_frequencies(index, len(vocabulary)), slop))
        block, following = following, next(parts, None)
    matches = found[0]
    if len(found) > 1:
        for other in found[1:]:
            matches = matches.union(other)
        # One row per block and document.
        matches = matches.groupBy("row", "doc_id", "n_words").agg(
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items")]
        ).select("row", "doc_id", "n_words", "starts", "stops", "items")
    return matches.mapInArrow(
        _summaries,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, row long",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(documents(spark, sf_dir), benchmark).drop("row")


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS t FROM (
    SELECT item, unnest([w[i : i + {WINDOW - 1}] FOR i IN range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)]) AS x
    FROM b WHERE len(w) > 0)
),
s AS (SELECT DISTINCT n FROM p),
dw AS (
  SELECT doc_id, n, x.i AS i, x.t AS t FROM (
    SELECT doc_id, n, unnest([{{'i': i, 't': array_to_string(w[i : i + n - 1], ' ')}} FOR i IN range(1, len(w) - n + 2)]) AS x
    FROM d, s WHERE len(w) >= n)
),
m AS (SELECT dw.doc_id, dw.i, dw.n, p.item FROM dw JOIN p ON dw.t = p.t AND dw.n = p.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM m) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
