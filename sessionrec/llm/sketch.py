"""Counting sketches over 64-bit keys: built in tasks, merged in streams, bounded in size.

A sketch is an array of ``width`` counters that stop at 255. A key raises ``probes`` of
them; its estimate is their smallest value and never under its true count (up to 255). So
an estimate of one proves that a key occurs once. With ``rows`` every probe has a row of
its own (count-min), without it all probes share one row (counting Bloom filter).

The width follows the number of keys up to ``MOST`` counters, so that what the driver
holds and broadcasts is at most ``probes`` x ``MOST`` bytes (``MOST`` without rows). Beyond
that more keys merely stay unproven; no result depends on it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

LEAST = 1 << 16
MOST = 1 << 25
PER_KEY = 8
CHUNK = 1 << 18  # counters in a piece that moves and is merged at a time
FULL = 255


class Sketch:
    """Counters of a table's keys; ``build`` fills them."""

    def __init__(self, keys: int, probes: int = 2, rows: bool = False, most: int = MOST):
        width = LEAST
        while width < min(keys * PER_KEY, most):
            width *= 2
        self.width, self.probes, self.rows = width, probes, rows
        self.size = width * (probes if rows else 1)

    def indexer(self):
        """A function from keys (int64) to cells (probes x keys), for tasks."""
        width, probes, rows = self.width, self.probes, self.rows

        def cells(keys: np.ndarray) -> np.ndarray:
            value = keys.astype(np.int64).view(np.uint64)
            out = np.empty((probes, len(value)), np.int64)
            for i in range(probes):
                mixed = (value ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(31)
                mixed *= np.uint64(0x94D049BB133111EB)
                out[i] = (mixed >> np.uint64(20)).astype(np.int64) & (width - 1)
                if rows:
                    out[i] += i * width
            return out

        return cells

    def build(self, df: DataFrame, key: str) -> np.ndarray:
        """The counters of all non-null ``key`` values of ``df``."""
        cells, size = self.indexer(), self.size
        chunk, full = min(CHUNK, size), FULL

        def packed(counters):
            numbers, blobs = [], []
            for i in range(0, size, chunk):
                part = counters[i : i + chunk]
                if part.any():
                    numbers.append(i // chunk)
                    blobs.append(zlib.compress(part.tobytes(), 1))
            arrays = [pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "counters"])

        def count(batches):
            counters = np.zeros(size, np.uint8)
            for batch in batches:
                found = cells(batch[key].drop_null().to_numpy(zero_copy_only=False))
                # Equal cells of one key count once, so that a lone key's estimate is one.
                for i in range(1, len(found)):
                    same = (found[:i] == found[i]).any(axis=0)
                    found[i] = np.where(same, -1, found[i])
                unique, times = np.unique(found[found >= 0], return_counts=True)
                counters[unique] = np.minimum(counters[unique] + times, full)
            yield packed(counters)

        def merge(batches):
            held, total = None, None
            for batch in batches:
                for number, blob in zip(batch["chunk"].to_pylist(), batch["counters"].to_pylist()):
                    part = np.frombuffer(zlib.decompress(blob), np.uint8)
                    if number != held:
                        if held is not None:
                            yield held, total
                        held, total = number, np.zeros(len(part), np.uint8)
                    total = np.minimum(total.astype(np.uint16) + part, full).astype(np.uint8)
            if held is not None:
                yield held, total

        def merged(batches):
            for number, total in merge(batches):
                arrays = [pa.array([number], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "counters"])

        schema = "chunk int, counters binary"
        parts = df.select(key).mapInArrow(count, schema)
        parts = parts.repartition(-(-size // chunk), "chunk").sortWithinPartitions("chunk")
        counters = np.zeros(size, np.uint8)
        for row in parts.mapInArrow(merged, schema).toLocalIterator():
            part = np.frombuffer(zlib.decompress(row.counters), np.uint8)
            counters[row.chunk * chunk : row.chunk * chunk + len(part)] = part
        return counters

    def repeated(self, df: DataFrame, counters: np.ndarray):
        """A function from a key column to a boolean column: false where a key is proven unique.

        Null keys give false.
        """
        cells = self.indexer()
        shared = df.sparkSession.sparkContext.broadcast(zlib.compress(counters.tobytes(), 1))
        opened: dict[str, np.ndarray] = {}

        def estimate(keys: pd.Series) -> pd.Series:
            if "counters" not in opened:
                opened["counters"] = np.frombuffer(zlib.decompress(shared.value), np.uint8)
            return pd.Series(opened["counters"][cells(keys.to_numpy())].min(axis=0) > 1)

        udf = F.pandas_udf(estimate, BooleanType())

        def column(key: Column | str) -> Column:
            key = F.col(key) if isinstance(key, str) else key
            # Nulls would reach the function as floats, which cannot hold 64-bit keys.
            return key.isNotNull() & udf(F.coalesce(key, F.lit(0).cast("bigint")))

        return column
