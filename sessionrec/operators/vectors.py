"""Vector search and query vectors."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrec.functions import columns as C
from sessionrec.functions.order import (
    best_first,
    last_events,
    newest_first,
    score_ranks,
    top_k,
)
from sessionrec.sources.stages import materialize

# Rows of one block; a cell of the search is one query block against one item block.
ITEM_BLOCK = 100_000
QUERY_BLOCK = 200_000

# Events per part of the query vectors; a part holds at most 17 newest items of each session.
EVENTS_PER_PART = 200_000

# Scores held at once inside a cell.
_CHUNK_CELLS = 4_000_000


def _cell_search(query: str, item: str, k: int, head: int | None = None) -> Callable:
    """Top k items of each query of one cell by cosine, ties by item id.

    Of these only the first ``head`` by 32-bit score stay, and all that tie with the last.
    Self-contained, so that workers need numpy and pandas but not this package.
    """

    def unit(vectors: pd.Series) -> np.ndarray:
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms == 0.0, 1.0, norms)

    def search(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({query: [], item: [], "score": []})
        if queries.empty or items.empty:
            return empty
        items = items.sort_values(item)
        ids, base = items[item].to_numpy(), unit(items["_item_vec"])
        keys, wanted = queries[query].to_numpy(), unit(queries["_query_vec"])
        take = min(k, len(ids))
        step = max(1, _CHUNK_CELLS // len(ids))
        parts = []
        for start in range(0, len(keys), step):
            scores = np.round(wanted[start : start + step] @ base.T, 9)
            # Scores that are one 32-bit float differ by less than the margin.
            last, margin = (head, 1e-6) if head and head < take else (take, 0.0)
            floor = -np.partition(-scores, last - 1, axis=1)[:, last - 1 : last]
            row, col = np.nonzero(scores >= floor - margin)
            value = scores[row, col]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < take
            if head and head < take:
                stored = value.astype(np.float32)
                best &= stored >= stored[place == head - 1][row]
            parts.append(
                pd.DataFrame(
                    {query: keys[start + row[best]], item: ids[col[best]], "score": value[best]}
                )
            )
        return pd.concat(parts, ignore_index=True)

    return search


def vector_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query: str = "session",
    item: str = "aid",
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
    head: int | None = None,
) -> DataFrame:
    """Exact cosine search: the k best items of each query, as query, item, score.

    With ``head``, only those of the k best that can be among the first ``head`` once scores
    are stored as 32-bit floats, in which close scores tie.

    A blocked matrix product: both sides are hashed into blocks of bounded size, each
    query block meets each item block in its own task, and a task passes on k rows
    per query. The final top k merges those. Nothing is broadcast. Both sides are
    counted first, so give tables rather than long plans.
    """
    n_items, n_queries = items.count(), queries.count()
    item_blocks = max(1, ceil(n_items / item_block))
    # Cells fill the cores evenly; copies of the items stay below the queries, or one per core.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    spread = min(4 * cores, max(cores, n_queries // max(1, n_items)), ceil(n_queries / 256))
    query_blocks = max(1, ceil(n_queries / query_block), spread)

    def blocks(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select(
        query,
        F.col("vec").alias("_query_vec"),
        F.pmod(F.xxhash64(query), F.lit(query_blocks)).cast("int").alias("_qb"),
        blocks(item_blocks).alias("_ib"),
    )
    right = items.select(
        item,
        F.col("vec").alias("_item_vec"),
        F.pmod(F.xxhash64(item), F.lit(item_blocks)).cast("int").alias("_ib"),
        blocks(query_blocks).alias("_qb"),
    )
    schema = T.StructType(
        [
            T.StructField(query, queries.schema[query].dataType),
            T.StructField(item, items.schema[item].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    cells = query_blocks * item_blocks
    found = (
        left.repartition(cells, "_qb", "_ib")
        .groupBy("_qb", "_ib")
        .cogroup(right.repartition(cells, "_qb", "_ib").groupBy("_qb", "_ib"))
        .applyInPandas(_cell_search(query, item, k, head), schema)
    )
    return top_k(found, [query], best_first("score", item), k)


def item_neighbours(items: DataFrame, k: int) -> DataFrame:
    """The k nearest items of each item: seed, aid, score."""
    seeds = items.withColumnRenamed("aid", "seed")
    return vector_topk(seeds, items, k, query="seed")


def last_query(events: DataFrame, items: DataFrame) -> DataFrame:
    """Query vector of a session: the vector of its newest item."""
    return last_events(events).select("session", "aid").join(items, "aid").select("session", "vec")


def seq_query(events: DataFrame, items: DataFrame) -> DataFrame:
    """Query vector of a session: recency-weighted sum of its newest items.

    The items, newest first, fill the weighted places cyclically, so only the newest
    ones (one per place at most) matter and each has a total weight of its places.
    """
    places = C.RECENCY_LENGTH
    known = events.join(items.select("aid"), "aid", "left_semi")
    newest = top_k(known.select("session", "aid", "ts", "eid"), ["session"], newest_first(), places, "_r")
    spark = events.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
        -(-events.count() // EVENTS_PER_PART),
    )
    part = F.pmod(F.xxhash64("session"), F.lit(parts)).cast("int")
    newest = materialize(newest.select(part.alias("part"), "session", "_r", "aid"), "newest-items")
    # A part of the sessions gets the vector of each of its items once.
    wanted = newest.select("part", "aid").distinct().join(items, "aid")
    near = wanted.select(F.col("part").alias("item_part"), F.col("aid").alias("item"), "vec")
    kind = dict(events.dtypes)["session"]
    return (
        newest.repartition(parts, "part")
        .groupBy("part")
        .cogroup(near.repartition(parts, "item_part").groupBy("item_part"))
        .applyInArrow(_weighted_sums(places, C.RECENCY_STEP), f"session {kind}, vec array<double>")
    )


def _weighted_sums(places: int, step: float) -> Callable:
    """Query vectors of the sessions of a part, from their items (place ``_r``) and the items' vectors.

    Vectors are added newest first. Self-contained, so that workers need numpy and pyarrow
    but not this package.
    """
    weight = np.zeros((places + 1, places + 1))
    for n in range(1, places + 1):
        for r in range(1, n + 1):
            for i in range(r - 1, places, n):
                weight[r, n] += 1.0 - step * i

    def one(found: list[tuple[float, list | None]]) -> list | None:
        """The sum where vectors are null, of several lengths or with nulls inside."""
        first = found[0][1]
        if first is None:
            return None
        total: list = [0.0] * len(first)
        for w, vec in found:
            for d, so_far in enumerate(total):
                value = vec[d] if vec is not None and d < len(vec) else None
                total[d] = None if so_far is None or value is None else so_far + w * value
        return total

    def run(rows: pa.Table, near: pa.Table) -> pa.Table:
        items = near["item"].to_numpy()
        by_item = np.argsort(items, kind="stable")
        vecs = near["vec"].combine_chunks().take(pa.array(by_item))
        rows = rows.sort_by([("session", "ascending"), ("_r", "ascending")]).combine_chunks()
        session = rows["session"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        aid, place = rows["aid"].to_numpy(), rows["_r"].to_numpy()
        first = np.searchsorted(items[by_item], aid)
        times = np.searchsorted(items[by_item], aid, side="right") - first
        starts = np.flatnonzero(np.concatenate([[True], session[1:] != session[:-1]])[: len(session)])
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(session))))
        w = weight[place, np.maximum.reduceat(place, starts)[of]] if len(starts) else np.empty(0)
        # The rows of the join, an item's several vectors one after the other.
        at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        of, w = np.repeat(of, times), np.repeat(w, times)
        size = np.bincount(of, minlength=len(starts))
        begins = np.cumsum(size) - size
        values, length = vecs.flatten(), vecs.value_lengths()
        if vecs.null_count or values.null_count or len(length.unique()) != 1:
            listed = list(zip(w.tolist(), vecs.take(pa.array(at)).to_pylist()))
            sums = pa.array([one(listed[a : a + n]) for a, n in zip(begins, size)], pa.list_(pa.float64()))
        else:
            matrix = values.to_numpy().astype(np.float64).reshape(len(vecs), -1)
            total = np.zeros((len(starts), matrix.shape[1]))
            for i in range(size.max(initial=0)):
                longer = np.flatnonzero(size > i)
                row = begins[longer] + i
                total[longer] += matrix[at[row]] * w[row][:, None]
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * matrix.shape[1])
            sums = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
        ids = rows["session"].take(pa.array(starts))
        return pa.table([ids, sums], names=["session", "vec"])

    return run


def embedding_candidates(
    events: DataFrame, items: DataFrame, cg: str, seed: str = "last", k: int = 300, head: int | None = None
) -> DataFrame:
    """Ranked nearest items of each session: session, aid, cg, score, ranks.

    Sessions with the same newest item share a query, so "last" searches and ranks once per
    item and joins the result to the sessions. With ``head``, the first so many rows only.
    """
    first = head or k
    if seed == "last":
        newest = last_events(events).select("session", F.col("aid").alias("seed"))
        wanted = items.join(newest.select(F.col("seed").alias("aid")).distinct(), "aid", "left_semi")
        near = vector_topk(wanted.withColumnRenamed("aid", "seed"), items, k, query="seed", head=head)
        ranked = score_ranks(near.withColumn("score", F.col("score").cast("float")), ["seed"])
        named = newest.join(ranked.filter(F.col("rank") <= first), "seed").withColumn("cg", F.lit(cg))
        return named.select("session", "aid", "cg", "score", "rank", "min_rank")
    elif seed == "seq":
        queries = materialize(seq_query(events, items), "queries")  # counted, then searched
        return as_candidates(vector_topk(queries, items, k, head=head), cg).filter(F.col("rank") <= first)
    raise ValueError(f"unknown seed {seed}")


def as_candidates(scored: DataFrame, cg: str) -> DataFrame:
    """Add generator name and ranks to search results (at most k per session)."""
    named = scored.select(
        "session", "aid", F.lit(cg).alias("cg"), F.col("score").cast("float").alias("score")
    )
    return score_ranks(named, ["session"])
