"""Item-to-item collaborative filter: pair weights and candidates.

A pair weight sums, over the sessions that hold both items, a product of damping
terms. All rules share one pass over the item pairs:

* the log is first reduced to one row per (session, item), so repeated and typed
  events multiply no pairs;
* a pair is formed once, unordered; both directions are weighted in that row;
* popularity depends on the two items only and is applied after the sum;
* a session with many items is cut into blocks, and each pair of blocks is its own
  join key. No task ever holds a whole session; every pair is still formed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionrec.functions import columns as C
from sessionrec.functions.order import best_first, score_ranks, top_k
from sessionrec.operators.sessions import TYPES, count_of, item_counts, present, session_items
from sessionrec.sources.events import is_type, max_ts
from sessionrec.sources.stages import Scratch, materialize, read_stage, write_stage

# Neighbours kept per item, candidates kept per session.
TOP_NEIGHBOURS = 300
TOP_CANDIDATES = 300

# Items per block of a long session; a pair of blocks is at most its square.
BLOCK_ITEMS = 1000


@dataclass(frozen=True)
class PairRule:
    """Which event types form a pair and which terms weight it."""

    source: tuple[int, ...] = (0, 1, 2)
    target: tuple[int, ...] = (0, 1, 2)
    popularity: bool = True
    decay: bool = True
    trend: bool = False
    session_size: bool = True
    future: bool = False
    drop_self: bool = False

    @property
    def name(self) -> str:
        types = "s{}_t{}".format(
            "".join(map(str, self.source)), "".join(map(str, self.target))
        )
        flags = [
            flag
            for flag, on in [
                ("pop", self.popularity),
                ("decay", self.decay),
                ("trend", self.trend),
                ("size", self.session_size),
                ("future", self.future),
                ("noself", self.drop_self),
            ]
            if on
        ]
        return "_".join(["item_cf", types, *flags])


# The nine published rules.
RULES = (
    PairRule((0, 1, 2), (0, 1, 2)),
    PairRule((1, 2), (1, 2)),
    PairRule((0,), (0,)),
    PairRule((0,), (1, 2)),
    PairRule((0,), (0, 1, 2)),
    PairRule((1, 2), (0, 1, 2)),
    PairRule((0, 1, 2), (0, 1, 2), trend=True, future=True),
    PairRule((1, 2), (0, 1, 2), trend=True, future=True),
    PairRule((0, 1, 2), (0, 1, 2), popularity=False, trend=True),
)

# Aggregations generated, aggregations merged.
AGGREGATIONS = ("sum", "mean", "max", "last", "count")
MERGED_AGGREGATIONS = ("sum", "last", "count")


def pair_cells(
    items: DataFrame, block_items: int = BLOCK_ITEMS, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Session items with the join cell(s) they take part in.

    A session of n items has ceil(n / block_items) blocks; an item of block b goes
    to the cells (b, other) of all blocks. Ordinary sessions have the cell (0, 0).
    ``size`` is the number of events of the session; ``extra`` names further item columns.
    """
    sessions = items.groupBy("session").agg(
        F.expr("sum(n0 + n1 + n2) AS size"),
        F.ceil(F.count(F.lit(1)) / block_items).cast("int").alias("_blocks"),
    )
    block = F.pmod(F.xxhash64("aid"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return (
        items.join(sessions, "session")
        .withColumn("_block", block)
        .select(
            "session", "aid", "size", "_block", *[f"t{t}" for t in TYPES], *extra, other
        )
        .withColumn("_cell_a", F.least("_block", "_other"))
        .withColumn("_cell_b", F.greatest("_block", "_other"))
        .drop("_other")
    )


# Pairs that a task of the pair join makes, about.
PAIRS_PER_TASK = 4_000_000

# Pairs shuffled at once, about: so many, or this multiple of the session items if more.
PAIRS_PER_SLICE = 32_000_000
PAIRS_PER_ROW = 2


def join_partitions(df: DataFrame, rows: int = 0) -> int:
    """Partitions of a multiplying join: the session's shuffle setting, every core busy,
    and more where the join makes more than ``PAIRS_PER_TASK`` rows for each."""
    spark = df.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        4 * spark.sparkContext.defaultParallelism,
        -(-rows // PAIRS_PER_TASK),
    )


# What an item pair is formed in: a session's cell. The size depends on the session.
CELL = ("session", "size", "_cell_a", "_cell_b")


def pairs_made(cells: DataFrame) -> tuple[int, int]:
    """Pairs that the cells make, and their rows."""
    sizes = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.expr("sum(n * n)"), F.sum("n")).first()
    return found[0] or 0, found[1] or 0


def unordered_pairs(cells: DataFrame, extra: tuple[str, ...] = (), made: int | None = None) -> DataFrame:
    """Each pair of items of a session once: ``a``, ``b`` (a <= b) with their times.

    Both sides of the join are the same cells, so they share one shuffle. Its number
    of partitions follows from the pairs, not from the rows, which are few and small
    here but multiply in the join. Columns of ``extra`` become a_<name> and b_<name>. ``made`` is
    what ``pairs_made`` finds, where that is at hand.
    """
    made = pairs_made(cells)[0] if made is None else made
    spread = cells.repartition(join_partitions(cells, made), *CELL)
    same_cell = " AND ".join(f"l.{c} = r.{c}" for c in CELL)
    joined = spread.alias("l").join(
        spread.alias("r"),
        F.expr(
            f"{same_cell} AND ((l._cell_a = l._cell_b AND l.aid <= r.aid) OR l._block < r._block)"
        ),
    )
    ordered = [
        column
        for name, lower, upper in [
            ("aid", "a", "b"),
            *[(f"t{t}", f"a{t}", f"b{t}") for t in TYPES],
            *[(c, f"a_{c}", f"b_{c}") for c in extra],
        ]
        for column in (
            f"if(l.aid <= r.aid, l.{name}, r.{name}) AS {lower}",
            f"if(l.aid <= r.aid, r.{name}, l.{name}) AS {upper}",
        )
    ]
    return joined.selectExpr("l.size AS size", *ordered)


def _direction(rule: PairRule, source: str, target: str) -> str:
    """SQL weight of one direction of a pair in one session; null if no events match.

    Uses the columns of ``_pair_terms``. Rules make many small terms, which read and
    parse faster as SQL text than as chained columns.
    """
    terms = []
    for i, j in product(rule.source, rule.target):
        near = f"near_{i}{j}" if source == "a" else f"near_{j}{i}"
        weight = near if rule.decay else f"if(isnotnull({near}), 1D, null)"
        if rule.trend:
            weight = f"{weight} * trend_{target}{j}"
        if rule.future:
            weight = f"if({source}{i} < {target}{j}, {weight}, null)"
        terms.append(weight)
    total = " + ".join(f"coalesce({t}, 0D)" for t in terms)
    damped = f"({total}) * damping" if rule.session_size else f"({total})"
    return f"if(isnotnull(coalesce({', '.join(terms)})), {damped}, null)"


def _pair_terms(pairs: DataFrame, events: DataFrame, used: list[int], trend: bool) -> DataFrame:
    """The terms all rules share, once per pair: near_<ij>, trend_<side><j>, damping."""
    near = [
        C.time_decay(F.col(f"a{i}"), F.col(f"b{j}")).alias(f"near_{i}{j}")
        for i, j in product(used, used)
    ]
    trends = []
    if trend:
        newest = max_ts(events)
        trends = [
            C.trend(newest, F.col(f"{side}{j}")).alias(f"trend_{side}{j}")
            for side, j in product("ab", used)
        ]
    damping = C.session_size_damping(F.col("size")).alias("damping")
    return pairs.select("*", *near, *trends, damping)


def _weighted_cells(
    events: DataFrame, rules: tuple[PairRule, ...], block_items: int
) -> tuple[list[int], DataFrame]:
    """The event types the rules use, and the cells of the items that have one."""
    # Read three times below (cells, session sizes, item counts).
    items = materialize(session_items(events), "session-items")
    used = sorted({t for r in rules for t in (*r.source, *r.target)})
    touched = F.coalesce(*[F.col(f"t{t}") for t in used]).isNotNull()
    # Item counts join the few session items here, so that the pairs carry them.
    cells = pair_cells(items.filter("aid IS NOT NULL"), block_items).filter(touched)
    counted = cells.join(item_counts(items).toDF("aid", "count"), "aid")
    return used, materialize(counted, "counted-cells")


def pair_weights(
    events: DataFrame,
    rules: tuple[PairRule, ...] = RULES,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """All pair weights of all rules: rule, aid, aid_right, weight (double)."""
    return _weights_of_cells(events, rules, *_weighted_cells(events, rules, block_items))


def _weights_of_cells(
    events: DataFrame,
    rules: tuple[PairRule, ...],
    used: list[int],
    cells: DataFrame,
    made: int | None = None,
) -> DataFrame:
    pairs = unordered_pairs(cells, ("count",), made)
    terms = _pair_terms(pairs, events, used, any(r.trend for r in rules))

    damped = _summed(terms, rules, ("forward", "back"))
    return _directed(damped, rules, (("a", "b", "forward"), ("b", "a", "back")))


def _summed(terms: DataFrame, rules: tuple[PairRule, ...], sides: tuple[str, ...]) -> DataFrame:
    """One row per item pair with the sum of every rule and side, and its popularity damping.

    Rules without trend and order of time add the same terms in other combinations, so these
    are summed once per pair of event types, and the rules' sums are made of them.
    """
    parts: dict[str, str] = {}
    sums = []
    for n, rule in enumerate(rules):
        for side in sides:
            if rule.trend or rule.future:
                name = f"{side}_{n}"
                parts[name] = _direction(rule, *("ab" if side == "forward" else "ba"))
                value = name
            else:
                names = []
                for i, j in product(rule.source, rule.target):
                    types = f"{i}{j}" if side == "forward" else f"{j}{i}"
                    weight = f"near_{types}" if rule.decay else f"if(isnotnull(near_{types}), 1D, null)"
                    name = f"sum_{int(rule.decay)}{int(rule.session_size)}_{types}"
                    parts[name] = f"{weight} * damping" if rule.session_size else weight
                    names.append(name)
                total = " + ".join(f"coalesce({name}, 0D)" for name in names)
                value = f"if(isnotnull(coalesce({', '.join(names)})), {total}, null)"
            sums.append(f"{value} AS {side}_{n}" if side == "forward" else f"if(a < b, {value}, null) AS {side}_{n}")
    grouped = terms.groupBy("a", "b").agg(
        F.max("a_count").alias("count_a"),
        F.max("b_count").alias("count_b"),
        *[F.expr(f"sum({value}) AS {name}") for name, value in parts.items()],
    )
    popular = C.popularity_damping(F.col("count_a"), F.col("count_b")).alias("popular")
    return grouped.select("a", "b", popular, *[F.expr(s) for s in sums])


def _directed(damped: DataFrame, rules: tuple[PairRule, ...], sides: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Summed pairs as rows rule, aid, aid_right, weight: for each side its two items and sum."""
    directed = ", ".join(
        f"struct({n} AS rule, {left} AS aid, {right} AS aid_right, "
        f"{value}_{n}{' * popular' if rule.popularity else ''} AS weight)"
        for n, rule in enumerate(rules)
        for left, right, value in sides
    )
    rows = damped.selectExpr(f"inline(array({directed}))").filter("weight IS NOT NULL")
    selfless = [n for n, r in enumerate(rules) if r.drop_self]
    if selfless:
        rows = rows.filter(~F.col("rule").isin(selfless) | (F.col("aid") != F.col("aid_right")))
    names = F.array(*[F.lit(r.name) for r in rules])
    return rows.withColumn("rule", names[F.col("rule")])


def item_pairs(
    events: DataFrame,
    rules: tuple[PairRule, ...] = RULES,
    neighbours: int = TOP_NEIGHBOURS,
    block_items: int = BLOCK_ITEMS,
    slices: int | None = None,
) -> DataFrame:
    """The strongest neighbours of each item per rule: rule, aid, aid_right, weight.

    Weights are stored as 32-bit floats. Besides the smaller table this makes ranks
    repeatable: the last bits of a distributed sum depend on the order of arrival.

    Where most pairs of a large catalogue differ, they are many times the log and merge
    little. They are then formed in ``slices`` of the items by hash: a slice holds all pairs
    from its items, is written with their neighbours, and its shuffle files go before the
    next one. By default the pairs of a slice follow the rows of the log.
    """

    def best(weights: DataFrame) -> DataFrame:
        stored = weights.withColumn("weight", F.col("weight").cast("float"))
        return top_k(stored, ["aid", "rule"], best_first("weight", "aid_right"), neighbours)

    used, cells = _weighted_cells(events, rules, block_items)
    made, rows = pairs_made(cells)
    if slices is None:
        # Equal pairs merge before the shuffle, at best to one row per pair and task.
        catalogue = cells.select("aid").distinct().count()
        moved = min(made, catalogue * catalogue * join_partitions(cells, made))
        slices = max(1, -(-moved // max(PAIRS_PER_SLICE, PAIRS_PER_ROW * rows)))
    if slices == 1:
        return best(_weights_of_cells(events, rules, used, cells, made))
    item = F.struct("_block", "aid", *[f"t{t}" for t in TYPES], "count")
    scratch = Scratch(events.sparkSession, "item-pairs")
    packed = scratch.table(cells.groupBy(*CELL).agg(F.collect_list(item).alias("items")), "cells")
    dealt = packed.repartition(join_partitions(packed, made // slices), *CELL)
    names = ["block", "", *TYPES, "_count"]
    left, right = ([f"{side}{name}" for name in names] for side in "ab")
    for i in range(slices):
        of_slice = f"filter(items, x -> pmod(xxhash64(x.aid, 'slice'), {slices}) = {i})"
        pairs = (
            dealt.selectExpr("size", "_cell_a = _cell_b AS one", "items", f"inline({of_slice}) AS ({', '.join(left)})")
            .selectExpr("size", "one", *left, f"inline(items) AS ({', '.join(right)})")
            .filter("one OR ablock <> bblock")
        )
        terms = _pair_terms(pairs, events, used, any(r.trend for r in rules))
        top = best(_directed(_summed(terms, rules, ("forward",)), rules, (("a", "b", "forward"),)))
        write_stage(top, f"{scratch.folder}/pairs/slice={i}")
    scratch.drop("cells")
    return read_stage(events.sparkSession, f"{scratch.folder}/pairs", top.schema).select(top.columns)


def pair_counts(events: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Ordered event pairs of the log without duplicates, counted per item pair."""
    items = materialize(session_items(events), "session-items")
    pairs = unordered_pairs(pair_cells(items, block_items))

    counted = pairs.groupBy("a", "b").agg(
        F.expr(f"sum({present('a')} * {present('b')}) AS pairs"), F.count(F.lit(1)).alias("sessions")
    )
    return counted.selectExpr(
        "inline(array_distinct(array(struct(a AS aid, b AS aid_right), struct(b AS aid, a AS aid_right))))",
        "pairs",
        "sessions",
    )


# Aggregates of a neighbour's weights ``w``, each counted ``n`` times; ``n`` is null where
# the item has no event of the rule's source types.
_AGGREGATES = {
    "sum": "sum({n} * {w})",
    "mean": "sum({n} * {w}) / sum(if(isnotnull({w}), {n}, null))",
    "max": "max(if(isnotnull({n}), {w}, null))",
    "min": "min(if(isnotnull({n}), {w}, null))",
    "count": "cast(sum(if(isnotnull({w}), {n}, null)) AS double)",
    "last": "sum(if({newest}, {w}, null))",
}


def _key(types: tuple[int, ...]) -> str:
    return "".join(map(str, types))


def _by_session(rows: DataFrame, near: DataFrame, sizes: str) -> DataFrame:
    """``rows`` dealt by session, in as many parts as their join with ``near`` needs.

    ``near`` has one row per item and ``sizes`` counts its neighbours. Where Spark can
    broadcast ``near``, everything up to the ranks of a session stays in its part.
    """
    used = rows.groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    made = used.join(near.selectExpr("aid", f"{sizes} AS k"), "aid").agg(F.expr("sum(n * k)")).first()[0]
    return rows.repartition(join_partitions(rows, made or 0), "session")


def neighbour_table(
    events: DataFrame,
    pairs: DataFrame,
    rules: tuple[PairRule, ...] = RULES,
    aggregations: tuple[str, ...] = AGGREGATIONS,
) -> DataFrame:
    """Weights of the neighbours of a session's items, aggregated per neighbour.

    One row per session and neighbour: ``scores`` holds rule by rule the aggregations in
    the order given, null where there is none. A pair of items is one row with the weights
    of all rules, so it meets a session's item once. Repeated events count repeatedly; they
    are joined once, with their number. ``last`` uses the newest source event only. ``std``
    needs the single values and is ``neighbour_std``.
    """
    used, packed = _used_and_near(events, pairs, rules, aggregations)
    joined = _by_session(used, packed, "size(near)").join(packed, "aid").drop("aid").select("*", F.inline("near"))
    return _aggregated(joined, rules, aggregations)


def _used_and_near(
    events: DataFrame, pairs: DataFrame, rules: tuple[PairRule, ...], aggregations: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    """A session's items with their events per source of the rules, and the neighbours per item."""
    sources = {_key(r.source): r.source for r in rules}
    items = session_items(events)
    if "last" in aggregations:
        edges = [
            F.expr(f"max(if({is_type(types)}, struct(ts, eid, aid), null)).aid AS last_{key}")
            for key, types in sources.items()
        ]
        items = items.join(events.groupBy("session").agg(*edges), "session")
    columns = []
    for key, types in sources.items():
        columns.append(f"nullif({count_of(types)}, 0) AS n_{key}")
        if "last" in aggregations:
            columns.append(f"{count_of(types)} > 0 AND aid <=> last_{key} AS newest_{key}")
    used = items.selectExpr("session", "aid", *columns)

    weights = [F.expr(f"max(if(rule = '{r.name}', weight, null)) AS w{i}") for i, r in enumerate(rules)]
    wide = pairs.groupBy("aid", "aid_right").agg(*weights)
    near = F.struct("aid_right", *[f"w{i}" for i in range(len(rules))])
    # An item's neighbours of all rules are one row (rules x top neighbours at most). Both
    # sides of the join are plain: a hot item can be split.
    packed = materialize(wide.groupBy("aid").agg(F.collect_list(near).alias("near")), "packed-neighbours")
    return used, packed


def _aggregated(joined: DataFrame, rules: tuple[PairRule, ...], aggregations: tuple[str, ...]) -> DataFrame:
    """``neighbour_table`` of the joined rows."""
    scores = [
        _AGGREGATES[a].format(
            n=f"n_{_key(r.source)}", w=f"cast(w{i} AS double)", newest=f"newest_{_key(r.source)}"
        )
        for i, r in enumerate(rules)
        for a in aggregations
    ]
    return (
        joined.groupBy("session", F.col("aid_right").alias("aid"))
        .agg(*[F.expr(f"{score} AS s{i}") for i, score in enumerate(scores)])
        .select("session", "aid", F.array(*[f"s{i}" for i in range(len(scores))]).alias("scores"))
    )


def neighbour_scores(
    events: DataFrame,
    pairs: DataFrame,
    rules: tuple[PairRule, ...] = RULES,
    aggregations: tuple[str, ...] = AGGREGATIONS,
) -> DataFrame:
    """``neighbour_table`` as one row per value: session, rule, aid, agg, score."""
    names = [(r.name, a) for r in rules for a in aggregations]
    long = ", ".join(
        f"struct('{rule}' AS rule, '{a}' AS agg, scores[{i}] AS score)" for i, (rule, a) in enumerate(names)
    )
    table = neighbour_table(events, pairs, rules, aggregations)
    rows = table.selectExpr("session", "aid", f"inline(array({long}))").filter("score IS NOT NULL")
    return rows.select("session", "rule", "aid", "agg", "score")


def neighbour_std(
    events: DataFrame, pairs: DataFrame, rules: tuple[PairRule, ...] = RULES
) -> DataFrame:
    """Sample standard deviation of the weights per neighbour; null for one value."""
    parts = []
    stored = materialize(pairs, "pairs")  # read twice for each rule
    for rule in rules:
        source = events.filter(F.col("type").isin(list(rule.source))).select("session", "aid")
        of_rule = stored.filter(F.col("rule") == rule.name).drop("rule")
        sizes = of_rule.groupBy("aid").agg(F.count(F.lit(1)).alias("k"))
        joined = _by_session(source, sizes, "k").join(of_rule, "aid")
        parts.append(
            joined.groupBy("session", "aid_right")
            .agg(F.stddev_samp(F.col("weight").cast("double")).alias("score"))
            .withColumn("rule", F.lit(rule.name))
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.select(
        "session", "rule", F.col("aid_right").alias("aid"), F.lit("std").alias("agg"), "score"
    )


def _ranker(count: int, k: int, marks: list[tuple[int, int]] | None = None) -> Callable:
    """Ranks of ``count`` scores per row among the rows of its session, the first ``k`` kept.

    With ``marks``, a bit and a number of first rows per score, only the set bits come back.
    Takes rows sorted by session and item, of whole sessions, as numpy: the sessions' ids for
    comparison, the scores and which of them are known; and the ids as they are returned.
    Self-contained, so that workers need numpy and pyarrow but not this package.
    """

    def ranked(session: np.ndarray, score: np.ndarray, known: np.ndarray, ids: list[pa.Array]) -> pa.RecordBatch:
        shape = score.shape
        starts = np.concatenate([[True], session[1:] != session[:-1]])[: len(session)]
        group = np.cumsum(starts) - 1
        begins = np.flatnonzero(starts)
        inside = np.arange(len(session)) - begins[group]
        low = int(inside.max(initial=0)).bit_length()
        short = score.dtype == np.float32 and low + len(begins).bit_length() <= 32
        key = ((group << (32 + low)) | inside).astype(np.uint64) if short else None

        def ordered(rows: np.ndarray, g: int) -> np.ndarray:
            """``rows`` by session, best score first; equal scores stay in item order."""
            value = np.float32(0) - score[rows, g]
            if key is None:
                return rows[np.lexsort((value, group[rows]))]
            # Session, score and place in the session are one number, whose sort is far quicker.
            value[np.isnan(value)] = np.nan
            bits = value.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            keys = np.sort(key[rows] | (bits << np.uint64(low)))
            place = (keys & np.uint64((1 << low) - 1)).astype(np.int64)
            return begins[(keys >> np.uint64(32 + low)).astype(np.int64)] + place

        rank, min_rank = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        marked = np.zeros(len(session), np.int64)
        for g in range(count):
            rows = np.flatnonzero(known[:, g])
            if not len(rows):
                continue
            rows = ordered(rows, g)
            of, value, place = group[rows], score[rows, g], np.arange(len(rows))
            first = np.concatenate([[True], of[1:] != of[:-1]])
            changed = first | np.concatenate([[True], value[1:] != value[:-1]])
            begin = np.maximum.accumulate(np.where(first, place, 0))
            if marks:
                bit, top = marks[g]
                marked[rows[place - begin < min(top, k)]] |= 1 << bit
                continue
            rank[rows, g] = place - begin + 1
            min_rank[rows, g] = np.maximum.accumulate(np.where(changed, place, 0)) - begin + 1
        if marks:
            rows = np.flatnonzero(marked)
            taken = [column.take(pa.array(rows)) for column in ids]
            return pa.RecordBatch.from_arrays([*taken, pa.array(marked[rows])], names=["session", "aid", "marks"])
        kept = (rank > 0) & (rank <= k)
        rows = np.flatnonzero(kept.any(axis=1))
        gone = ~kept[rows].ravel()
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count)
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(values[rows].ravel(), mask=gone))
            for values in (score, rank, min_rank)
        ]
        taken = [column.take(pa.array(rows)) for column in ids]
        return pa.RecordBatch.from_arrays(
            [*taken, *lists], names=["session", "aid", "scores", "ranks", "min_ranks"]
        )

    return ranked


def _batch_ranker(count: int, ranked: Callable) -> Callable:
    """``ranked`` over batches of session, aid and scores, sorted by session and item."""

    def keys(table: pa.Table) -> np.ndarray:
        """Ids in the order of the rows: null, which sorts first, is below any id."""
        ids = table["session"].cast(pa.int64())
        return ids.fill_null(np.iinfo(np.int64).min).to_numpy()

    def of_table(table: pa.Table) -> pa.RecordBatch:
        session = keys(table)
        flat = table["scores"].combine_chunks().flatten()
        shape = (len(session), count)
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(shape)
        score = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(shape)
        return ranked(session, score, known, [table[c].combine_chunks() for c in ("session", "aid")])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            session = keys(table)
            # The last session may go on in the next batch.
            whole = int(np.searchsorted(session, session[-1])) if len(session) else 0
            if whole:
                yield of_table(table.slice(0, whole).combine_chunks())
            held = table.slice(whole)
        if held is not None and held.num_rows:
            yield of_table(held.combine_chunks())

    return run


def ranked_neighbours(
    events: DataFrame,
    pairs: DataFrame,
    rules: tuple[PairRule, ...] = RULES,
    aggregations: tuple[str, ...] = MERGED_AGGREGATIONS,
    candidates: int = TOP_CANDIDATES,
) -> DataFrame:
    """Ranked candidates of all rules and aggregations, one row per session and item.

    ``scores``, ``ranks`` and ``min_ranks`` hold a value for each generator in the order of
    ``generator_names``, null where it does not store the item. Every generator orders
    the same rows of a session, so these are sorted and moved once for all of them.
    """
    kinds = dict(events.dtypes)
    schema = (
        f"session {kinds['session']}, aid {kinds['aid']}, "
        "scores array<float>, ranks array<int>, min_ranks array<int>"
    )
    ranker = _ranker(len(rules) * len(aggregations), candidates)
    return _through_ranker(events, pairs, rules, aggregations, ranker, schema)


def marked_neighbours(
    events: DataFrame,
    pairs: DataFrame,
    bits: dict[str, tuple[int, int]],
    rules: tuple[PairRule, ...] = RULES,
    aggregations: tuple[str, ...] = MERGED_AGGREGATIONS,
    candidates: int = TOP_CANDIDATES,
) -> DataFrame:
    """``ranked_neighbours`` that a generator selects: session, aid and the set bits as ``marks``.

    ``bits`` gives the bit and the number of first rows of each generator.
    """
    kinds = dict(events.dtypes)
    marks = [bits[name] for name in generator_names(rules, aggregations)]
    schema = f"session {kinds['session']}, aid {kinds['aid']}, marks bigint"
    return _through_ranker(events, pairs, rules, aggregations, _ranker(len(marks), candidates, marks), schema)


# A session of more items is joined and aggregated row by row, not in one task's memory.
LONG_ITEMS = 2000

# Pairs of a session's item and a neighbour that a task holds at once, about, and those of its part.
PAIRS_AT_ONCE = 500_000
PAIRS_PER_PART = 2_000_000

# Aggregations that sum or count, so need no order of the pairs.
_SUMMED = {"sum", "mean", "count", "last"}


def _through_ranker(
    events: DataFrame,
    pairs: DataFrame,
    rules: tuple[PairRule, ...],
    aggregations: tuple[str, ...],
    ranker: Callable,
    schema: str,
    long_items: int = LONG_ITEMS,
) -> DataFrame:
    """What ``ranker`` makes of the neighbour table.

    Sessions are dealt into parts, and a part gets the neighbours of each of its items once,
    not once per session. Its pairs are summed and ranked in the same task, in chunks.
    """
    used, packed = _used_and_near(events, pairs, rules, aggregations)
    count = len(rules) * len(aggregations)

    def row_by_row(rows: DataFrame) -> DataFrame:
        joined = _by_session(rows, packed, "size(near)").join(packed, "aid").drop("aid").select("*", F.inline("near"))
        ordered = _ordered(_aggregated(joined, rules, aggregations))
        return ordered.mapInArrow(_batch_ranker(count, ranker), schema)

    if not set(aggregations) <= _SUMMED:
        return row_by_row(used)
    used = materialize(used, "session-sources")
    sizes = packed.selectExpr("aid", "size(near) AS k")
    found = used.groupBy("aid").agg(F.count(F.lit(1)).alias("n")).join(sizes, "aid")
    found = found.agg(F.expr("sum(n * k)").alias("made"), F.count(F.lit(1)).alias("items")).first()
    long = None
    if found["items"] > long_items:
        longer = used.groupBy("session").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long_items)
        long = materialize(longer.select("session"), "long-sessions")
        long = None if long.isEmpty() else long
    short = used
    if long is not None:
        of_long = F.col("long.session").eqNullSafe(F.col("rows.session"))
        short = used.alias("rows").join(long.alias("long"), of_long, "left_anti")
        long = used.alias("rows").join(long.alias("long"), of_long, "left_semi")
    parts = max(join_partitions(used), -(-(found["made"] or 0) // PAIRS_PER_PART))
    dealt = short.withColumn("part", F.pmod(F.xxhash64("session"), F.lit(parts)).cast("int"))
    wanted = dealt.select("part", "aid").distinct().join(packed, "aid")
    near = wanted.select(F.col("part").alias("near_part"), F.col("aid").alias("item"), "near")
    scorer = _scorer(rules, aggregations, ranker)
    # Part numbers are spread by the same hash on both sides, so neither moves again.
    ranked = (
        dealt.repartition(parts, "part")
        .groupBy("part")
        .cogroup(near.repartition(parts, "near_part").groupBy("near_part"))
        .applyInArrow(scorer, schema)
    )
    return ranked if long is None else ranked.unionByName(row_by_row(long))


def _scorer(rules: tuple[PairRule, ...], aggregations: tuple[str, ...], ranker: Callable) -> Callable:
    """``ranker`` over the neighbour table of the sessions of one part.

    Gets the part's session items and the neighbours of those items. An item that counts for a
    source has a number of events there, so a score is known where the counted events are not zero.
    Self-contained, so that workers need numpy and pyarrow but not this package.
    """
    sources = [_key(r.source) for r in rules]
    at_once, n_rules = PAIRS_AT_ONCE, len(rules)
    width_of_row = n_rules * len(aggregations)

    def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places start, start + 1, ... of every list, one list after the other."""
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def run(rows: pa.Table, near: pa.Table) -> pa.Table:
        none = [pa.array([], rows.schema.field(c).type) for c in ("session", "aid")]
        shape = (0, width_of_row)
        out = [ranker(np.empty(0, np.int64), np.empty(shape, np.float32), np.empty(shape, bool), none)]
        lists = near["near"].combine_chunks()
        flat = lists.flatten()
        if not rows.num_rows or not len(flat):
            return pa.Table.from_batches(out)
        length = lists.value_lengths().to_numpy()
        begin = np.cumsum(length) - length
        neighbours, target = np.unique(flat.field("aid_right").to_numpy(), return_inverse=True)
        weights, valid = [], []
        for i in range(n_rules):
            column = flat.field(f"w{i}")
            weights.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
            valid.append(column.is_valid().to_numpy(zero_copy_only=False).astype(np.float64) if column.null_count else None)

        rows = rows.filter(rows["aid"].is_valid()).combine_chunks()
        items = near["item"].to_numpy()
        by_item = np.argsort(items)
        aid = rows["aid"].to_numpy()
        place = np.minimum(np.searchsorted(items[by_item], aid), len(items) - 1)
        hit = items[by_item][place] == aid
        rows, listed = rows.filter(pa.array(hit)).combine_chunks(), by_item[place[hit]]
        session = rows["session"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.argsort(session, kind="stable")
        rows, listed, session = rows.take(pa.array(order)).combine_chunks(), listed[order], session[order]
        numbers = {s: rows[f"n_{s}"].fill_null(0).to_numpy().astype(np.float64) for s in set(sources)}
        newest = {}
        if "last" in aggregations:
            newest = {s: rows[f"newest_{s}"].fill_null(False).to_numpy() for s in set(sources)}
        ids = rows["session"].combine_chunks() if isinstance(rows["session"], pa.ChunkedArray) else rows["session"]

        starts = np.flatnonzero(np.concatenate([[True], session[1:] != session[:-1]])) if len(session) else []
        ends = np.append(starts[1:], len(session)) if len(starts) else []
        made = np.concatenate([[0], np.cumsum(length[listed])])
        first = 0
        while first < len(starts):
            # Whole sessions, one at least.
            last = int(np.searchsorted(made[ends], made[starts[first]] + at_once, side="right"))
            last = max(last, first + 1)
            lo, hi = starts[first], ends[last - 1]
            first = last
            size = length[listed[lo:hi]]
            group = np.cumsum(np.concatenate([[0], session[lo + 1 : hi] != session[lo : hi - 1]]))
            at = spread(begin[listed[lo:hi]], size)
            if not len(at):
                continue
            key = np.repeat(group, size) * len(neighbours) + target[at]
            width = (int(group[-1]) + 1) * len(neighbours)
            cells = None
            if width > 4 * len(key):
                cells, key = np.unique(key, return_inverse=True)
                width = len(cells)
            kept = np.flatnonzero(np.bincount(key, minlength=width))
            # Filled and ranked column by column.
            score = np.zeros((len(kept), width_of_row), np.float32, order="F")
            known = np.zeros(score.shape, bool, order="F")
            counts: dict[str, np.ndarray] = {}
            times = {s: np.repeat(n[lo:hi], size) for s, n in numbers.items()}
            heads = {}
            for s, flags in newest.items():
                chosen = np.flatnonzero(flags[lo:hi])
                places = spread(begin[listed[lo:hi][chosen]], size[chosen])
                heads[s] = places, key[spread((np.cumsum(size) - size)[chosen], size[chosen])]
            for i, s in enumerate(sources):
                if valid[i] is not None:
                    number = np.bincount(key, times[s] * valid[i][at], width)[kept]
                else:
                    if s not in counts:
                        counts[s] = np.bincount(key, times[s], width)[kept]
                    number = counts[s]
                total = None
                for j, agg in enumerate(aggregations):
                    column = i * len(aggregations) + j
                    if agg == "last":
                        places, cell = heads[s]
                        some = np.ones(len(places)) if valid[i] is None else valid[i][places]
                        value = np.bincount(cell, weights[i][places], width)[kept]
                        known[:, column] = np.bincount(cell, some, width)[kept] > 0
                    else:
                        known[:, column] = number > 0
                        if agg != "count" and total is None:
                            total = np.bincount(key, times[s] * weights[i][at], width)[kept]
                        value = {"sum": total, "count": number}.get(agg)
                        if agg == "mean":
                            value = total / np.where(number > 0, number, 1)
                    score[:, column] = value
            cell = kept if cells is None else cells[kept]
            of, to = cell // len(neighbours), cell % len(neighbours)
            leads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            columns = [ids.take(pa.array(lo + leads[of])), pa.array(neighbours[to])]
            out.append(ranker(of, score, known, columns))
        return pa.Table.from_batches(out)

    return run


def _ordered(table: DataFrame) -> DataFrame:
    """The neighbour table in 32-bit scores, whole sessions in a part, by session and item."""
    scored = table.select("session", "aid", F.col("scores").cast("array<float>").alias("scores"))
    # Keeps the parts of the join where they already hold whole sessions.
    place = F.row_number().over(Window.partitionBy("session").orderBy("aid"))
    numbered = scored.withColumn("_place", place).filter("_place > 0").drop("_place")
    return numbered.sortWithinPartitions("session", "aid")


def generator_names(
    rules: tuple[PairRule, ...] = RULES, aggregations: tuple[str, ...] = MERGED_AGGREGATIONS
) -> list[str]:
    return [f"{r.name}_{a}" for r in rules for a in aggregations]


def item_cf_candidates(
    events: DataFrame,
    pairs: DataFrame,
    rules: tuple[PairRule, ...] = RULES,
    aggregations: tuple[str, ...] = MERGED_AGGREGATIONS,
    candidates: int = TOP_CANDIDATES,
) -> DataFrame:
    """Ranked candidates of all rules and aggregations: session, aid, cg, score, ranks."""
    found = []
    plain = tuple(a for a in aggregations if a != "std")
    if plain:
        long = ", ".join(
            f"struct('{name}' AS cg, scores[{i}] AS score, ranks[{i}] AS rank, min_ranks[{i}] AS min_rank)"
            for i, name in enumerate(generator_names(rules, plain))
        )
        ranked = ranked_neighbours(events, pairs, rules, plain, candidates)
        found.append(ranked.selectExpr("session", "aid", f"inline(array({long}))").filter("rank IS NOT NULL"))
    if "std" in aggregations:
        named = neighbour_std(events, pairs, rules).select(
            "session",
            "aid",
            F.concat_ws("_", "rule", "agg").alias("cg"),
            F.col("score").cast("float").alias("score"),
        )
        best = top_k(
            named,
            ["session", "cg"],
            [F.col("score").desc_nulls_last(), F.col("aid").asc()],
            candidates,
        )
        # At most ``candidates`` rows per session and generator from here on.
        found.append(score_ranks(best, ["session", "cg"]))
    return reduce(DataFrame.unionByName, found)
