"""Fuzzy line dedup by MinHash with exact verification.

Equal lines are merged first, by a 128-bit hash. Each distinct line has a MinHash
signature over its character shingles, cut into ``BANDS`` bands of ``BAND_ROWS`` values: a
pair with Jaccard similarity 0.8 shares a band with probability 0.985, one of 0.9 with
0.9999. Lines that share a band are candidates and are compared exactly, set with set:
first every line of a bucket with the bucket's most frequent line, its head, which costs
one comparison per line however large the bucket is. After the components of those links
are known, only pairs of different components are of interest, as pairs in one component
change nothing. The lines of a head are then dealt into cells of bounded size, and every
cell of lines that stand apart from their head meets every cell of the head's other lines:
an inverted list over the shingles of the first counts what each of the second shares.
Only links leave a cell. Every candidate pair is so either compared or already joined, and
no pairs are written out. One line of each component stays: the first by document id and
line number.

Every line with a character beside white space takes part. A line shorter than a shingle
is its own only shingle, so it meets equal lines only; blank lines always stay.

Defined cases: null text stays null and has no lines; a document may lose all lines and
is then empty; rows that repeat both id and text count as one document and are treated
alike; null ids come last in the order; an empty table gives an empty result. Other
columns are kept by ``dedup_text`` and ignored elsewhere.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import documents, with_rows
from sessionrec.llm.components import components, forest
from sessionrec.sources.stages import materialize, materialize_alone

SHINGLE = 7
SIMILARITY = 0.8
BANDS = 8
BAND_ROWS = 4
LEAST = 1
# A character that is not Unicode white space.
NOT_BLANK = r"(?U)\S"
CELL = 100_000  # distinct shingles that a cell's inverted list holds, about
# Characters hashed at a time: small arrays stay in the processor's cache.
_CHARACTERS = 1 << 16


def permutations(count: int) -> np.ndarray:
    """Odd multipliers of the hash permutations, from a fixed seed."""
    return np.random.default_rng(7).integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_hashes(points: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """32-bit hash of every run of ``width`` code points."""
    n = len(points) - width + 1
    value = points[:n] * np.uint32(0x9E3779B1)
    for i in range(1, width):
        value = (value ^ (value >> np.uint32(15)) ^ points[i : n + i]) * np.uint32(0x85EBCA77)
    return value ^ (value >> np.uint32(13))


def signatures(lines: list[str], width: int = SHINGLE, count: int = BANDS * BAND_ROWS) -> np.ndarray:
    """MinHash values (lines x count); every line has at least ``width`` characters."""
    out = np.empty((len(lines), count), np.uint32)
    multipliers = permutations(count)
    at = 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and (stop == at or size + len(lines[stop]) <= _CHARACTERS):
            size += len(lines[stop])
            stop += 1
        group = lines[at:stop]
        values = shingle_hashes(np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32), width)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in group])[:-1]])
        # Runs that reach over the end of a line are left out: every second slice.
        cuts = np.empty(2 * len(group), np.int64)
        cuts[0::2] = starts
        cuts[1::2] = starts + [len(x) - width + 1 for x in group]
        cuts = cuts[:-1] if cuts[-1] >= len(values) else cuts
        for k, multiplier in enumerate(multipliers):
            mixed = values * multiplier
            mixed ^= mixed >> np.uint32(16)
            out[at:stop, k] = np.minimum.reduceat(mixed, cuts)[0::2]
        at = stop
    return out


def bands(signature: np.ndarray, count: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band (lines x bands)."""
    keys = np.full((len(signature), count), 0x9E3779B97F4A7C15, np.uint64)
    keys *= np.arange(1, count + 1, dtype=np.uint64)
    for i in range(rows):
        keys ^= signature[:, i::rows][:, :count].astype(np.uint64)
        keys *= np.uint64(0xFF51AFD7ED558CCD)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def shingles(line: str, width: int = SHINGLE) -> frozenset:
    return frozenset(line[i : i + width] for i in range(max(1, len(line) - width + 1)))


def jaccard(a: str, b: str, width: int = SHINGLE) -> float:
    x, y = shingles(a, width), shingles(b, width)
    common = len(x & y)
    return common / (len(x) + len(y) - common) if x or y else 1.0


class LineDedup:
    """The steps of line dedup under one set of parameters."""

    def __init__(self, similarity=SIMILARITY, width=SHINGLE, bands=BANDS, band_rows=BAND_ROWS, least=LEAST):
        self.similarity = similarity
        self.width = width
        self.bands = bands
        self.band_rows = band_rows
        self.least = least

    def parts(self):
        """A function from a line to its shingles, for tasks."""
        return partial(shingles, width=self.width)

    def lines(self, docs: DataFrame) -> DataFrame:
        """doc_id, body, number, line, h1, h2 of every line that may be dropped.

        ``body`` is a hash of the text: with the id it names the document.
        """
        text = F.col("text")
        return (
            docs.select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.split(text, "\n")).alias("number", "line"))
            .filter((F.length("line") >= self.least) & F.col("line").rlike(NOT_BLANK))
            .withColumn("h1", F.xxhash64("line"))
            .withColumn("h2", F.xxhash64(F.lit(1), "line"))
        )

    def signed(self, lines: DataFrame) -> DataFrame:
        """Lines with their band keys in place of the text; none for lines under a shingle."""

        width, count, rows = self.width, self.bands, self.band_rows

        def run(batches):
            for batch in batches:
                lines = batch["line"].to_pylist()
                signed = np.array([len(x) >= width for x in lines], bool)
                long = [x for x in lines if len(x) >= width]
                keys = bands(signatures(long, width, count * rows), count, rows)
                offsets = np.concatenate([[0], np.cumsum(signed * count)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                names = ["doc_id", "body", "number", "h1", "h2"]
                yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], column], [*names, "keys"])

        return lines.mapInArrow(run, "doc_id long, body long, number int, h1 long, h2 long, keys array<bigint>")

    def line_texts(self, wanted: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
        """(node, line) of the wanted nodes; a text is read where the line stands first."""
        keys = nodes.join(wanted, "node").select("node", "h1", "h2", F.col("doc_id").alias("_id"), "body", "number")
        place = ["h1", "h2", "body", "number"]
        met = lines.join(keys, place).filter(F.col("doc_id").eqNullSafe(F.col("_id")))
        # Repeated rows give a line twice; the join's own keys keep them together.
        return materialize(met.dropDuplicates([*place, "node"]).select("node", "line"), "line-texts")

    @staticmethod
    def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        line = {name: texts.withColumnsRenamed({"node": name, "line": f"line_{name}"}) for name in ("a", "b")}
        return pairs.join(line["b"], "b").join(line["a"], "a").select("a", "b", "line_a", "line_b")

    def compared(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b, size_a, size_b, common) in shingles, for every pair."""

        shingled = self.parts()

        def run(batches):
            # Pairs of one line come together; the cache goes with the task.
            parts = lru_cache(maxsize=4)(shingled)
            for batch in batches:
                out = []
                for x, y in zip(batch["line_a"].to_pylist(), batch["line_b"].to_pylist()):
                    x, y = parts(x), parts(y)
                    out.append((len(x), len(y), len(x & y)))
                columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)]
                names = ["a", "b", "size_a", "size_b", "common"]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *columns], names)

        schema = "a long, b long, size_a long, size_b long, common long"
        return self.with_texts(pairs, texts).mapInArrow(run, schema)

    def similar(self, pairs: DataFrame) -> DataFrame:
        union = F.col("size_a") + F.col("size_b") - F.col("common")
        return pairs.filter(F.col("common") >= self.similarity * union).select("a", "b")

    def open_links(self, stars: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b): links between lines of one head that the stars have not joined."""

        def named(name):
            return labels.select(F.col("node").alias(name), F.col("component").alias(f"class_{name}"))

        known = (
            stars.join(named("a"), "a", "left")
            .join(named("b"), "b", "left")
            .withColumn("class_a", F.coalesce("class_a", "a"))
            .withColumn("apart", F.col("class_a") != F.coalesce("class_b", "b"))
        )
        known = known.select(
            F.col("b").alias("head"), F.col("a").alias("node"), F.col("class_a").alias("class"), "apart", "size_a"
        )
        known = materialize(known, "star-classes")
        loose = F.sum(F.when(F.col("apart"), F.col("size_a")))
        heads = known.groupBy("head").agg(
            F.count("*").alias("n"),
            F.ceil(loose / CELL).cast("int").alias("rows"),
            F.ceil(F.sum("size_a") / (4 * CELL)).cast("int").alias("columns"),
        )
        # A head with one other line has no further pair.
        heads = heads.filter("rows is not null and n > 1").drop("n")
        opened = known.join(materialize(heads, "open-heads"), "head").join(texts, "node")
        opened = materialize(opened.repartition("node"), "open-lines")
        spread = F.xxhash64("node")

        def dealt(df, own, count, other, others, side):
            return df.select(
                "head",
                F.pmod(spread, F.col(count)).cast("int").alias(own),
                F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other),
                F.lit(side).alias("side"),
                "node",
                "class",
                "apart",
                "line",
            ).select("head", "i", "j", "side", "node", "class", "apart", "line")

        met = dealt(opened.filter("apart"), "i", "rows", "j", "columns", 0).union(
            dealt(opened, "j", "columns", "i", "rows", 1)
        )
        met = met.repartition("head", "i", "j").sortWithinPartitions("head", "i", "j", "side", "node")

        shingled, similarity = self.parts(), self.similarity

        def run(batches):
            cell, first, index, links = None, [], {}, []

            def out():
                found = forest(links)
                columns = [pa.array(c, pa.int64()) for c in (list(found.keys()), list(found.values()))]
                return pa.RecordBatch.from_arrays(columns, ["a", "b"])

            for batch in batches:
                for head, i, j, side, node, group, apart, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if cell != (head, i, j):
                        if links:
                            yield out()
                        cell, first, index, links = (head, i, j), [], {}, []
                    own = shingled(line)
                    if side == 0:
                        for shingle in own:
                            index.setdefault(shingle, []).append(len(first))
                        first.append((node, group, len(own)))
                        continue
                    if not any(group != other for _, other, _ in first):
                        continue
                    lists = [index[shingle] for shingle in own if shingle in index]
                    common = np.bincount(np.fromiter(chain.from_iterable(lists), np.int64), minlength=len(first))
                    for k in np.flatnonzero(common):
                        a, other, size = first[k]
                        shared = int(common[k])
                        if other != group and (not apart or a > node):
                            if shared >= similarity * (size + len(own) - shared):
                                links.append((a, node))
            if links:
                yield out()

        return met.mapInArrow(run, "a long, b long")

    def classes(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(occurrences, nodes): every droppable line, and every distinct one with its class."""
        lines = self.lines(docs)
        table = materialize(self.signed(lines), "lines")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number", "body")
        nodes = with_rows(
            table.groupBy("h1", "h2")
            .agg(F.min(order).alias("first"), F.any_value("keys").alias("keys"), F.count("*").alias("n"))
            .select("h1", "h2", "first", "first.doc_id", "first.body", "first.number", "keys", "n"),
            "distinct-lines",
            "place",
        )
        # Numbers of lines with more copies are smaller: the likeliest originals come first.
        level = F.lit(7) - F.least(F.lit(7), F.floor(F.log2("n")))
        nodes = nodes.withColumn("node", F.shiftleft(level.cast("bigint"), 60) + F.col("place")).drop("place", "n")
        members = nodes.select("node", F.explode("keys").alias("key"))
        buckets = members.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("lines"))
        buckets = materialize(buckets.filter("lines > 1").drop("lines"), "buckets")
        held = members.join(buckets, "key").filter("node != head")
        stars = materialize(held.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "star-pairs")
        wanted = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct()
        texts = self.line_texts(wanted, nodes, lines)
        stars = materialize(self.compared(stars, texts), "stars")
        labels = materialize(components(self.similar(stars)), "labels")
        joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = materialize(components(joined.union(self.open_links(stars, labels, texts))), "labels")
        classed = nodes.drop("keys", "doc_id", "body", "number").join(labels, "node", "left")
        return table, classed.withColumn("component", F.coalesce("component", "node"))

    def dropped(self, docs: DataFrame) -> DataFrame:
        """doc_id, body, dropped (sorted line numbers) of the documents that lose lines."""
        table, nodes = self.classes(docs)
        nodes = materialize(nodes, "classed-lines")
        first = nodes.groupBy("component").agg(F.min("first").alias("stays"))
        stays = materialize(nodes.join(first, "component").select("h1", "h2", "stays"), "stays")
        here = (
            F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
            & (F.col("body") == F.col("stays.body"))
            & (F.col("number") == F.col("stays.number"))
        )
        return (
            table.drop("keys")
            .join(stays, ["h1", "h2"])
            .filter(~here)
            .groupBy("doc_id", "body")
            .agg(F.array_sort(F.collect_set("number")).alias("dropped"))
        )

    def dedup_text(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` less its dropped lines; every column and row stays."""
        columns = docs.columns
        narrow = docs.select("doc_id", "text")
        drops = materialize_alone(docs.sparkSession, "dropped-lines", lambda: self.dropped(narrow)).select(
            F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("dropped").alias("_dropped")
        )
        keyed = docs.withColumn("_hash", F.xxhash64("text"))
        met = keyed.join(drops, (F.col("_hash") == F.col("_body")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        # Lines keep their order, so a sorted list of numbers is turned into the rest.
        lines = F.split("text", "\n")
        kept = F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped")),
                lambda i: F.get(lines, i),
            ),
            "\n",
        )
        text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept)
        return met.withColumn("text", text).select(*columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped: the line numbers that go, comma-joined."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    drops = materialize_alone(spark, "dropped-lines", lambda: LineDedup().dropped(docs))
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("_hash"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
    )
    met = rows.join(
        drops.withColumnsRenamed({"doc_id": "_id", "body": "_body"}),
        (F.col("_hash") == F.col("_body")) & F.col("doc_id").eqNullSafe(F.col("_id")),
        "left",
    )
    gone = F.coalesce(F.size("dropped"), F.lit(0))
    return met.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - gone).alias("n_kept"),
        F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"),
    )
