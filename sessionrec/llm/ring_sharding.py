"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 60-bit hashes; a row belongs to the arc
that ends at the next point clockwise. Rows arrive in ring order. A shard takes rows
until it is full; the rows beyond continue clockwise to the next shard that has room.
With the law ``rows`` the bounds are the row count dealt out evenly (floor or ceiling),
so counts are at most one apart, and a row leaves its own shard only if that is full.

The ring has shards x vnodes arcs, however many rows there are. Row counts by arc are
summed in Spark; the walk around the ring runs over those counts alone and gives at
most arcs + shards runs of rows, each with its shard and first slot. A row finds its
run by its place in its arc: slices of an arc are sorted apart and shifted by the sizes
of those before, so no task sorts a whole arc.

Defined cases: null text has size 1; rows without an id are placed by their text; rows
equal in id and text are interchangeable and take neighbouring slots; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionrec.llm.common import documents

RING = 1 << 60
VNODES = 128
SLICE_ROWS = 200_000


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in ring order."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard {shard} node {v}".encode()).hexdigest()
            points.append((int(digest[:15], 16), shard))
    return sorted(points)


def row_bounds(rows: int, shards: int) -> list[int]:
    """How many rows each shard takes: all rows, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(arc_rows: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first row of the arc, rows, shard, first slot) of the bounded ring.

    Arcs are walked in ring order; each gives its rows to its owner as long as that has
    room, then to the owners of the points that follow.
    """
    used = [0] * len(bounds)
    runs = []
    for arc, rows in enumerate(arc_rows):
        done, at = 0, arc
        while done < rows:
            shard = owners[at % len(owners)]
            take = min(rows - done, bounds[shard] - used[shard])
            if take:
                runs.append((arc, done, take, shard, used[shard]))
                used[shard] += take
                done += take
            at += 1
    return runs


def ring_shards(
    docs: DataFrame, shards: int = 8, vnodes: int = VNODES, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    ``home_shard`` is the owner of the row's arc: where the unbounded ring puts it.
    """
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    positions = [p for p, _ in points]
    owners = [s for _, s in points]
    text = F.col("text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit(""))))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint").alias("place"),
    )
    total = docs.count()
    # Slices of equal width in hash space, so of about slice_rows rows each.
    width = max(1, RING // max(1, total // slice_rows))

    def locate(batches):
        ends = np.array(positions, dtype=np.int64)
        starts = np.roll(ends, 1)
        for batch in batches:
            place = batch["place"].to_numpy()
            arc = np.searchsorted(ends, place) % len(ends)
            offset = (place - starts[arc]) % RING
            yield batch.append_column("arc", pa.array(arc.astype(np.int32))).append_column(
                "offset", pa.array(offset)
            ).append_column("part", pa.array(offset // width))

    rows = rows.mapInArrow(
        locate, "doc_id long, size long, text_crc32 long, place long, arc int, offset long, part long"
    )
    sizes = rows.groupBy("arc", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    by_arc = {r["arc"]: r["n"] for r in sizes.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    arc_rows = [by_arc.get(a, 0) for a in range(len(points))]
    runs = walk(arc_rows, owners, row_bounds(total, shards))
    run_table = spark.createDataFrame(runs, "arc int, first long, run long, shard int, slot0 long")
    inside = Window.partitionBy("arc", "part").orderBy("offset", "doc_id", "text_crc32", "size")
    placed = (
        rows.withColumn("inner", F.row_number().over(inside) - 1)
        .join(offsets, ["arc", "part"])
        .withColumn("rank", F.col("before") + F.col("inner"))
    )
    owner = F.element_at(F.array(*[F.lit(s) for s in owners]), F.col("arc") + 1)
    # At most arcs + shards runs: a bound that does not depend on the rows.
    return (
        placed.join(F.broadcast(run_table), "arc")
        .filter("rank >= first and rank < first + run")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            owner.alias("home_shard"),
        )
    )


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(documents(spark, sf_dir))
