"""Candidate merge: union of generators, labels, scores, votes, folds.

Candidates of all generators live in one long table (session, aid, cg, score, rank,
min_rank). The merge is one grouping by (session, aid) with conditional aggregates
instead of two joins per generator.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionrec.functions.order import score_ranks, sliced_positions
from sessionrec.operators.item_cf import MERGED_AGGREGATIONS, RULES
from sessionrec.sources.events import EVENT_GROUPS, TARGETS
from sessionrec.sources.stages import materialize

N_FOLDS = 3


@dataclass(frozen=True)
class Generator:
    """A generator in the merge: rows taken per session, weight of its vote."""

    name: str
    top: int = 20
    weight: float = 1.0


# Rows merged and vote weight per generator family.
HISTORY = tuple(Generator(f"last_{g}", 20, 2.0) for g in EVENT_GROUPS)
ITEM_CF = tuple(
    Generator(f"{rule.name}_{agg}", 40, 0.7) for rule in RULES for agg in MERGED_AGGREGATIONS
)
ITEM_MF = (Generator("item_mf_last", 40, 3.0), Generator("item_mf_seq", 40, 3.0))
USER_MF = (Generator("user_mf", 40, 3.0),)
ITEM2VEC = (Generator("item2vec_last", 20, 1.0), Generator("item2vec_seq", 20, 1.0))
ALL_GENERATORS = (*HISTORY, *ITEM_CF, *ITEM_MF, *USER_MF, *ITEM2VEC)


def _chosen(generators: tuple[Generator, ...]) -> str:
    """SQL condition: a row is among the first rows of its generator."""
    return " OR ".join(f"(cg = '{g.name}' AND rank <= {g.top})" for g in generators)


def selected_pairs(candidates: DataFrame, generators: tuple[Generator, ...]) -> DataFrame:
    """Distinct (session, aid) among the first rows of every generator."""
    return candidates.filter(_chosen(generators)).select("session", "aid").distinct()


def wide_candidates(candidates: DataFrame, generators: tuple[Generator, ...]) -> DataFrame:
    """Merged candidates with flag, score, rank and min rank per generator.

    A pair is kept if any generator selects it; scores and ranks come from all stored
    rows of a generator, -1 where it has none.
    """
    known = candidates.filter(F.col("cg").isin([g.name for g in generators]))
    values = [
        F.expr(f"max(if(cg = '{g.name}', {column}, null)) AS {g.name}_{name}")
        for g in generators
        for column, name in (
            ("score", "score"),
            ("rank", "score_rank"),
            ("min_rank", "score_min_rank"),
        )
    ]
    grouped = (
        known.groupBy("session", "aid")
        .agg(F.expr(f"max({_chosen(generators)}) AS chosen"), *values)
        .filter("chosen")
    )
    columns = [
        column
        for g in generators
        for column in (
            f"cast(coalesce({g.name}_score_rank <= {g.top}, false) AS tinyint)"
            f" AS {g.name}_score_selected",
            f"coalesce({g.name}_score, cast(-1 AS float)) AS {g.name}_score",
            f"coalesce({g.name}_score_rank, -1) AS {g.name}_score_rank",
            f"coalesce({g.name}_score_min_rank, -1) AS {g.name}_score_min_rank",
        )
    ]
    return grouped.selectExpr("session", "aid", *columns)


@dataclass(frozen=True)
class Family:
    """Candidates that share rows: session, aid and the arrays scores, ranks, min_ranks.

    ``places`` gives the position of each generator in the arrays; a value is null where
    the generator does not store the item. One position can serve several generators.
    """

    rows: DataFrame
    places: dict[str, int]


def packed_family(candidates: DataFrame, names: tuple[str, ...]) -> Family:
    """Long candidates of few generators as one row per session and item."""
    arrays = [
        F.array(*[F.expr(f"max(if(cg = '{name}', {column}, null))") for name in names]).alias(f"{column}s")
        for column in ("score", "rank", "min_rank")
    ]
    known = candidates.filter(F.col("cg").isin(list(names)))
    return Family(known.groupBy("session", "aid").agg(*arrays), {n: i for i, n in enumerate(names)})


def single_family(candidates: DataFrame, names: tuple[str, ...]) -> Family:
    """Long candidates of one search that stands for all generators of ``names``."""
    arrays = [F.array(c).alias(f"{c}s") for c in ("score", "rank", "min_rank")]
    return Family(candidates.select("session", "aid", *arrays), dict.fromkeys(names, 0))


def selected_of_families(
    families: list[Family], generators: tuple[Generator, ...], parts: int
) -> DataFrame:
    """``selected_pairs`` of packed candidates, dealt by session into ``parts``."""
    heads = []
    for family in families:
        tops: dict[int, int] = {}
        for g in generators:
            if g.name in family.places:
                place = family.places[g.name]
                tops[place] = max(g.top, tops.get(place, 0))
        first = " OR ".join(f"coalesce(ranks[{i}] <= {top}, false)" for i, top in tops.items())
        heads.append(family.rows.filter(first or "false").select("session", "aid"))
    return reduce(DataFrame.unionByName, heads).repartition(parts, "session").distinct()


def wide_of_families(
    families: list[Family], generators: tuple[Generator, ...], parts: int
) -> DataFrame:
    """``wide_candidates`` of packed candidates, dealt by session into ``parts``.

    A row of a family holds all its generators, so a pair meets as many rows as there are
    families, not generators. Later steps by session need no further shuffle.
    """
    rows = [
        f.rows.select(F.lit(i).alias("family"), "session", "aid", "scores", "ranks", "min_ranks")
        for i, f in enumerate(families)
    ]
    arrays = [
        F.expr(f"first(if(family = {i}, {column}, null), true) AS {column}_{i}")
        for i in range(len(families))
        for column in ("scores", "ranks", "min_ranks")
    ]
    dealt = reduce(DataFrame.unionByName, rows).repartition(parts, "session")
    grouped = dealt.groupBy("session", "aid").agg(*arrays)
    columns, chosen = [], []
    for g in generators:
        found = [(i, f.places[g.name]) for i, f in enumerate(families) if g.name in f.places]
        score, rank, min_rank = (
            f"{column}_{found[0][0]}[{found[0][1]}]" if found else f"cast(null AS {kind})"
            for column, kind in (("scores", "float"), ("ranks", "int"), ("min_ranks", "int"))
        )
        chosen.append(f"coalesce({rank} <= {g.top}, false)")
        columns += [
            f"cast({chosen[-1]} AS tinyint) AS {g.name}_score_selected",
            f"coalesce({score}, cast(-1 AS float)) AS {g.name}_score",
            f"coalesce({rank}, -1) AS {g.name}_score_rank",
            f"coalesce({min_rank}, -1) AS {g.name}_score_min_rank",
        ]
    return grouped.filter(" OR ".join(chosen)).selectExpr("session", "aid", *columns)


def generator_bits(generators: tuple[Generator, ...]) -> dict[str, tuple[int, int]]:
    """Bit of each generator in the column ``marks``, and the rows it selects per session."""
    if len(generators) > 63:
        raise ValueError("a long holds the marks of at most 63 generators")
    return {g.name: (bit, g.top) for bit, g in enumerate(generators)}


def marked_candidates(candidates: DataFrame, bits: dict[str, tuple[int, int]]) -> DataFrame:
    """Long candidates that their generator selects, with its bit: session, aid, marks."""
    marks = " ".join(
        f"WHEN cg = '{name}' AND rank <= {top} THEN {1 << bit}L" for name, (bit, top) in bits.items()
    )
    return candidates.selectExpr("session", "aid", f"CASE {marks} END AS marks").filter("marks IS NOT NULL")


def marked_search(candidates: DataFrame, names: tuple[str, ...], bits: dict[str, tuple[int, int]]) -> DataFrame:
    """Candidates of one search that stands for all generators of ``names``, with their bits."""
    marks = " | ".join(f"if(rank <= {bits[n][1]}, {1 << bits[n][0]}L, 0L)" for n in names)
    return candidates.selectExpr("session", "aid", f"{marks} AS marks").filter("marks <> 0")


def selected_of_marks(marked: list[DataFrame], parts: int) -> DataFrame:
    """``selected_pairs`` of marked candidates, dealt by session into ``parts``."""
    heads = [rows.select("session", "aid") for rows in marked]
    return reduce(DataFrame.unionByName, heads).repartition(parts, "session").distinct()


def votes_of_marks(marked: list[DataFrame], generators: tuple[Generator, ...], parts: int) -> DataFrame:
    """The votes of ``add_votes`` without scores and ranks of the generators.

    A vote depends on the selected rows only, and all votes of a pair are one number, so
    the grouping has one fixed-size value per pair. Votes are added in the generators' order.
    """
    dealt = reduce(DataFrame.unionByName, marked).repartition(parts, "session")
    grouped = dealt.groupBy("session", "aid").agg(F.expr("bit_or(marks) AS marks"))
    weighted = " + ".join(f"(shiftright(marks, {bit}) & 1) * {g.weight}D" for bit, g in enumerate(generators))
    return _vote_ranks(grouped, "cast(bit_count(marks) AS int)", weighted).drop("marks")


def add_votes(merged: DataFrame, generators: tuple[Generator, ...]) -> DataFrame:
    """Number of votes, weighted votes and their ranks in the session.

    A session has at most the sum of all ``top`` values as rows here.
    """
    votes = " + ".join(f"cast({g.name}_score_selected AS int)" for g in generators)
    weighted = " + ".join(f"{g.name}_score_selected * {g.weight}D" for g in generators)
    return _vote_ranks(merged, votes, weighted)


def _vote_ranks(merged: DataFrame, votes: str, weighted: str) -> DataFrame:
    scored = merged.selectExpr(
        "*",
        f"cast({votes} AS tinyint) AS cand_feature_selected_num",
        f"cast({weighted} AS float) AS cand_feature_selected_score",
    )
    return score_ranks(
        scored,
        ["session"],
        "cand_feature_selected_score",
        rank="cand_feature_selected_rank",
        min_rank="cand_feature_selected_min_rank",
    )


def add_targets(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """target_click / target_cart / target_order (0 or 1) from the truth lists."""
    truth = (
        labels.select("session", "type", F.explode("ground_truth").alias("aid"))
        .groupBy("session", "aid")
        .agg(
            *[
                F.max((F.col("type") == t).cast("tinyint")).alias(f"target_{n}")
                for n, t in TARGETS.items()
            ]
        )
    )
    filled = {
        f"target_{n}": F.coalesce(f"target_{n}", F.lit(0).cast("tinyint")) for n in TARGETS
    }
    return pairs.join(truth, ["session", "aid"], "left").withColumns(filled)


def add_no_targets(pairs: DataFrame) -> DataFrame:
    """no_target_*: 1 where a session has no positive row of that target."""
    session = Window.partitionBy("session")
    return pairs.withColumns(
        {
            f"no_target_{n}": (F.sum(f"target_{n}").over(session) == 0).cast("tinyint")
            for n in TARGETS
        }
    )


def drop_empty_sessions(pairs: DataFrame) -> DataFrame:
    """Sessions without any positive row leave the training data."""
    kept = reduce(lambda a, b: a | b, [F.col(f"no_target_{n}") == 0 for n in TARGETS])
    return pairs.filter(kept)


def label_candidates(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return drop_empty_sessions(add_no_targets(add_targets(pairs, labels)))


def _dealt(counts: list[tuple[int, int]], folds: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, first, cycle) for the sizes given with their numbers of sessions, largest first.

    Every session goes to the fold with the fewest rows, of equal ones to the lowest. Once the
    folds are less than one size apart, sessions of that size go round in one order: the
    folds of ``first`` take one each, then those of ``cycle`` in turn.
    """
    loads = [0] * folds
    out = []
    for size, count in sorted(counts, reverse=True):
        first: list[int] = []
        while len(first) < count and max(loads) - min(loads) >= size:
            lightest = loads.index(min(loads))
            loads[lightest] += size
            first.append(lightest)
        cycle = sorted(range(folds), key=lambda f: (loads[f], f))
        rounds, rest = divmod(count - len(first), folds)
        loads = [n + rounds * size for n in loads]
        for f in cycle[:rest]:
            loads[f] += size
        out.append((size, first, cycle))
    return out


def session_folds(pairs: DataFrame, folds: int = N_FOLDS) -> DataFrame:
    """Fold per session: largest sessions first, each into the fold with the fewest rows.

    Sessions of one size are taken in id order. Only the distinct sizes reach the driver: at
    most sqrt(2 x rows), and no more than the sum of the generators' tops for candidates.
    """
    sizes = pairs.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "session-sizes")
    counts = [(r["n"], r["count"]) for r in sizes.groupBy("n").count().collect()]
    rule = pairs.sparkSession.createDataFrame(
        _dealt(counts, folds), "n long, first array<int>, cycle array<int>"
    )
    placed = sliced_positions(sizes, ["n"], [F.col("session").asc()], "_pos").join(rule, "n")
    turn = F.col("_pos") - F.size("first")
    fold = F.when(turn < 0, F.get("first", F.col("_pos").cast("int"))).otherwise(
        F.get("cycle", F.pmod(turn, F.lit(folds)).cast("int"))
    )
    return placed.select("session", fold.cast("tinyint").alias("fold"))


def add_folds(pairs: DataFrame, folds: int = N_FOLDS) -> DataFrame:
    """All rows of a session share one fold."""
    return pairs.join(session_folds(pairs, folds), "session")

