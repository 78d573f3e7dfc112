"""Training rows in blocks: whole sessions side by side, one matrix of features per block.

A block holds about ``BLOCK_ROWS`` rows of whole sessions (whose candidates are bounded by
the generators' tops), sorted by session and item. Its features are one matrix, feature by
feature: bins of one byte for trees, or 32-bit values for linear rankers. The blocks
of all folds are written once and read by every pass of every fold's model.

Functions for tasks are self-contained, so that workers need numpy and pyarrow but not this
package.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
BLOCKS = "n int, ids binary, folds binary, labels binary, margins binary, features binary"


def feature_array(features: list[str]) -> Column:
    """All features as one column: it reaches a task's Python in half the time of one column each."""
    return F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>")


def feature_matrix(width: int) -> Callable:
    """A function from a batch's ``feature_array`` to a matrix of its rows, unknown values as NaN."""

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    return matrix


def blocks(
    rows: DataFrame,
    target: str,
    features: list[str],
    fold: Column,
    start_score: str | None = None,
    models: int = 1,
    cuts: list[list[float]] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``rows`` in blocks (``BLOCKS``); ``ids`` are sessions and items, ``margins`` one list per model.

    With ``cuts`` a feature is the number of cuts under its value, unknown ones have none; else
    it is its value, and unknown ones are 0.
    """
    width = len(features)
    kind = np.dtype(np.uint8 if cuts is not None else np.float32)
    start = F.coalesce(F.col(start_score).cast("double"), F.lit(0.0)) if start_score else F.lit(0.0)
    read = rows.select(
        F.col("session").cast("bigint").alias("session"),
        F.col("aid").cast("bigint").alias("aid"),
        F.coalesce(F.col(target), F.lit(0)).cast("tinyint").alias("label"),
        fold.cast("tinyint").alias("fold"),
        start.alias("margin"),
        feature_array(features).alias("features"),
    )
    matrix_of = feature_matrix(width)

    def narrow(batches):
        for batch in batches:
            n = batch.num_rows
            known, table = matrix_of(batch["features"]), np.empty((n, width), kind)
            if cuts is None:
                table[:] = np.where(np.isnan(known), 0.0, known)
            else:
                known = np.where(np.isnan(known), -np.inf, known).T.copy()
                for i in range(width):
                    table[:, i] = np.searchsorted(np.array(cuts[i], np.float64), known[i], side="left")
            offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width * kind.itemsize)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(table.tobytes())])
            keys = [batch[c] for c in ("session", "aid", "label", "fold", "margin")]
            yield pa.RecordBatch.from_arrays([*keys, packed], ["session", "aid", "label", "fold", "margin", "features"])

    def sessions_of(table: pa.Table) -> np.ndarray:
        return table["session"].fill_null(np.iinfo(np.int64).min).to_numpy()

    def block(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        flat = b"".join(c.buffers()[2][o[0] : o[-1]].to_pybytes() for c, o in (
            (c, np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in table["features"].chunks if len(c)
        )) if width else b""
        matrix = np.ascontiguousarray(np.frombuffer(flat, kind).reshape(n, width).T)
        margin = table["margin"].to_numpy()
        columns = [
            np.stack([sessions_of(table), table["aid"].fill_null(np.iinfo(np.int64).min).to_numpy()]),
            table["fold"].to_numpy().astype(np.int8),
            table["label"].to_numpy().astype(np.int8),
            np.stack([margin] * models),
            matrix,
        ]
        arrays = [pa.array([n], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]]
        return pa.RecordBatch.from_arrays(arrays, ["n", "ids", "folds", "labels", "margins", "features"])

    def dealt(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < block_rows:
                continue
            session = sessions_of(held)
            # The last session may go on in the next batch.
            begins = np.flatnonzero(np.concatenate([[True], session[1:] != session[:-1]]))
            first = 0
            for last in begins[1:]:
                if last - first >= block_rows or last == begins[-1]:
                    yield block(held.slice(first, last - first))
                    first = int(last)
            held = held.slice(first)
        if held is not None and held.num_rows:
            yield block(held)

    each = read.mapInArrow(narrow, "session long, aid long, label tinyint, fold tinyint, margin double, features binary")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sorted_rows = each.repartition(parts, "session").sortWithinPartitions("session", "aid")
    return sorted_rows.mapInArrow(dealt, BLOCKS)


def block_reader(width: int, kind) -> Callable:
    """A function from batches of blocks to ids, folds, labels, margins, matrix and session numbers of each."""
    kind = np.dtype(kind)

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch["n"][i].as_py()

                def column(name, of):
                    return np.frombuffer(batch[name][i].as_buffer(), of)

                ids = column("ids", np.int64).reshape(2, n)
                group = np.cumsum(np.concatenate([[0], ids[0, 1:] != ids[0, :-1]])) if n else np.zeros(0, np.int64)
                matrix = column("features", kind).reshape(width, n)
                yield ids, column("folds", np.int8), column("labels", np.int8), column("margins", np.float64).reshape(-1, n), matrix, group

    return read


def session_pairs(cut: int) -> tuple[Callable, Callable]:
    """Functions over rows of whole sessions, given with ascending session numbers.

    ``pairs``: positive row, other row of its session and the change of NDCG that swapping
    them in the ranking by margin makes. ``ndcg``: NDCG of each session with a positive row.
    """
    ideals = np.concatenate([[1.0], np.cumsum(1.0 / np.log2(np.arange(2, cut + 2)))])

    def discounts(margins: np.ndarray, group: np.ndarray) -> np.ndarray:
        order = np.lexsort((-margins, group))  # ties by item, as rows are sorted by it
        first = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
        inside = np.arange(len(group))
        inside = inside - np.maximum.accumulate(np.where(first, inside, 0))
        place = np.empty(len(group), np.int64)
        place[order] = inside + 1
        return np.where(place <= cut, 1.0 / np.log2(place + 1.0), 0.0)

    def pairs(margins: np.ndarray, labels: np.ndarray, group: np.ndarray):
        positive, other = np.flatnonzero(labels > 0), np.flatnonzero(labels <= 0)
        sessions = int(group[-1]) + 1 if len(group) else 0
        found, others = np.bincount(group[positive], minlength=sessions), np.bincount(group[other], minlength=sessions)
        discount = discounts(margins, group)
        times = others[group[positive]]
        a = np.repeat(positive, times)
        begin = (np.cumsum(others) - others)[group[positive]]
        b = other[np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        worth = np.abs(discount[a] - discount[b]) / ideals[np.minimum(found[group[a]], cut)]
        return a, b, worth

    def ndcg(margins: np.ndarray, labels: np.ndarray, group: np.ndarray) -> np.ndarray:
        hit = labels > 0
        sessions = int(group[-1]) + 1 if len(group) else 0
        found = np.bincount(group[hit], minlength=sessions)
        gained = np.bincount(group[hit], discounts(margins, group)[hit], sessions)
        judged = np.flatnonzero(found)
        return gained[judged] / ideals[np.minimum(found[judged], cut)]

    return pairs, ndcg
