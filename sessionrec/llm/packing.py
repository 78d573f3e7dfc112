"""Best-fit packing of token pieces under several capacities.

Documents become pieces of at most ``capacity`` tokens. A sequence has room for so many
tokens, so many pieces and so much attention cost (the sum of squared piece lengths). A
piece's needs follow from its length, so pieces of one length are interchangeable and the
whole corpus is described by how many pieces have each length: at most ``capacity``
numbers. Best-fit decreasing runs on those numbers. Equal open sequences are one entry with
a multiplicity; pieces of one length fill the entry that scores best among all that hold
one more piece under every constraint, then the next, and new sequences last. The score
is the weighted norm of what would be left over, or, with ``rule="dot"``, the weighted
dot product of the piece's needs with what is left. The plan has a few thousand
entries at most, whatever the number of documents, and equals packing piece by piece.

Pieces find their places by their number among the pieces of their length. Each task
numbers its own pieces; counts by task shift the numbers. Nothing is sorted.

Defined cases: null text is empty (one piece with the end id alone); repeated rows are
packed apart; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionrec.llm.common import documents, texts
from sessionrec.llm.tokens import tokenizer
from sessionrec.sources.stages import materialize

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weight of each in the score.

    The defaults of pieces and attention never bind (a piece has a token at least, and
    squares sum to capacity squared at most), so sequences are limited by tokens alone.
    """

    tokens: int = CAPACITY
    pieces: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"

    def whole(self) -> tuple[int, int, int]:
        return self.tokens, self.pieces, self.attention


def needs(length: int) -> tuple[int, int, int]:
    return length, 1, length * length


def room_for(left: tuple[int, ...], need: tuple[int, ...]) -> int:
    """How many such pieces fit."""
    return min(a // b for a, b in zip(left, need))


def score(left: tuple[int, ...], need: tuple[int, ...], limits: Limits) -> float:
    """Smaller is better."""
    whole = limits.whole()
    if limits.rule == "dot":
        # Most aligned with what is left, as a fraction of each capacity.
        return -sum(w * (a / c) * (b / c) for w, a, b, c in zip(limits.weights, left, need, whole))
    return sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(limits.weights, left, need, whole))


@dataclass
class Bins:
    """``count`` equal sequences: what is left in each, and (length, pieces, offset) placed."""

    left: tuple[int, int, int]
    count: int
    placed: tuple[tuple[int, int, int], ...] = ()

    def plus(self, length: int, pieces: int, count: int) -> Bins:
        need = needs(length)
        offset = sum(n * k for n, k, _ in self.placed)
        left = tuple(a - pieces * b for a, b in zip(self.left, need))
        return Bins(left, count, (*self.placed, (length, pieces, offset)))


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> list[Bins]:
    """Best-fit decreasing over (length -> pieces)."""
    open_bins: list[Bins] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        need = needs(length)
        whole = room_for(limits.whole(), need)
        if whole < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        fitting = [b for b in open_bins if room_for(b.left, need) > 0]
        # A sequence keeps scoring best while it is filled with equal pieces.
        for bins in sorted(fitting, key=lambda b: (score(b.left, need, limits), b.left, b.placed)):
            if not left:
                break
            each = room_for(bins.left, need)
            full = min(bins.count, left // each)
            rest = left - full * each if full < bins.count else 0
            rest = min(rest, each - 1)
            if full:
                open_bins.append(bins.plus(length, each, full))
            if rest:
                open_bins.append(bins.plus(length, rest, 1))
            bins.count -= full + (rest > 0)
            left -= full * each + rest
        start = Bins(limits.whole(), 0)
        if left // whole:
            open_bins.append(start.plus(length, whole, left // whole))
        if left % whole:
            open_bins.append(start.plus(length, left % whole, 1))
        open_bins = [b for b in open_bins if b.count]
    return open_bins


def pieces(
    docs: DataFrame, path: str | Callable[[], str], capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and number in it.

    A document longer than ``capacity`` is cut so that only its first piece is shorter.
    ``number`` counts the pieces of the same length in the same task.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = tokenizer(path() if callable(path) else path).packed
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text) + end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - start) % capacity or capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    number = seen.get(length, 0)
                    seen[length] = number + 1
                    out.append((doc_id, piece, start, length, crc, part, number))
                    start += length
                    piece += 1
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
            )

    return texts(docs).mapInArrow(run, PIECE_SCHEMA)


def place(table: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``table`` (written pieces) with sequence_id and offset."""
    counts = materialize(table.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # At most one row per length.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins in plan(histogram, limits):
        for length, each, offset in bins.placed:
            first = used.get(length, 0)
            runs.setdefault(length, []).append((first, each, offset, sequence))
            used[length] = first + each * bins.count
        sequence += bins.count
    tables = {length: np.array(r, np.int64) for length, r in runs.items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = table.join(shifts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("shift")).alias("number")
    )

    def run(batches):
        for batch in batches:
            length = batch["length"].to_numpy()
            number = batch["number"].to_numpy()
            sequence_id = np.zeros(len(length), np.int64)
            offset = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for value, at in zip(values, np.split(order, starts[1:])):
                firsts, each, offsets, sequences = tables[int(value)].T
                k = np.searchsorted(firsts, number[at], side="right") - 1
                inside = number[at] - firsts[k]
                sequence_id[at] = sequences[k] + inside // each[k]
                offset[at] = offsets[k] + inside % each[k] * value
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(sequence_id),
                    pa.array(offset),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file's place on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, path=vocabulary_path, end_id: int = END_ID, limits: Limits = Limits()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(materialize(pieces(docs, path, limits.tokens, end_id), "pieces"), limits)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
