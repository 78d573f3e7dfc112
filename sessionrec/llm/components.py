"""Connected components by distributed union-find: local forests, then star contraction.

Each task first joins up to ``FOREST`` links by union-find and passes on one link per node;
a second time over tasks of ``TASK`` links each, so the number of tasks grows with the links.
Then large stars and small stars alternate until every node points at the smallest node of
its component. Node labels only get smaller and each step is written to the shared folder, so
a lost executor repeats one step. No task holds a component: the smallest neighbour of a
node is a partial aggregate, and it meets the node's links in a join of two plain tables,
which adaptive execution splits when one node has very many links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.sources.stages import materialize

FOREST = 200_000  # links that a task holds at a time
TASK = 50_000


def forest(pairs) -> dict[int, int]:
    """Node -> smallest node, for the links given."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = root.setdefault(x, x)
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _local(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        found = forest(zip(*(np.concatenate(side).tolist() for side in zip(*held))))
        nodes = np.fromiter(found.keys(), np.int64, len(found))
        roots = np.fromiter(found.values(), np.int64, len(found))
        moved = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], ["a", "b"])

    size = 0
    for batch in batches:
        held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        size += batch.num_rows
        if size >= FOREST:
            yield out()
            held.clear()
            size = 0
    if held:
        yield out()


def _smallest(links: DataFrame) -> DataFrame:
    """a -> m, the smallest b of each a; written so that the join below has two plain sides."""
    return materialize(links.groupBy("a").agg(F.min("b").alias("m")), "smallest")


def large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.join(_smallest(both), "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger node to the smaller one."""
    met = links.join(_smallest(links), "a")
    return (
        met.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(met.filter("b = m").select("a", "b"))
        .distinct()
    )


def _done(links: DataFrame) -> bool:
    """Every node has one link at most, and no target has one."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes that have links; ``links`` has bigint a and b.

    ``component`` is the smallest node reachable. A node without links is not listed.
    Repeated links, links both ways and links of a node with itself are allowed.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    links = materialize(pairs.mapInArrow(_local, "a long, b long"), "forests")
    tasks = -(-links.count() // TASK)
    links = materialize(links.coalesce(max(1, tasks)).mapInArrow(_local, "a long, b long").distinct(), "links")
    while not _done(links):
        links = materialize(small_star(materialize(large_star(links), "large-star")), "small-star")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
