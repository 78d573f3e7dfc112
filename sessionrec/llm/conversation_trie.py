"""Prefix trie of rebuilt conversations, with count-min screening of prefix digests.

Turns are reduced to digests where they are read; texts never move. A conversation's rows
are sorted inside a task and chained in one stream: the digest of a prefix is that of the
prefix before it and the next turn. A count-min sketch of all prefix digests then proves
most prefixes to belong to one conversation only. Such a node, and everything below it, is
known without any other row, and is written where it stands. Only prefixes that may be
shared are shuffled and grouped exactly.

Subtree figures need no walk over levels. A node is owned by its smallest member, which
owns every node below it on its own path as well; a conversation therefore adds to each
node on its path what the owned nodes from there on are worth: a running sum along the
path, then one sum per node. Leaves and children are counted in the same way.

Hot groups: rows of a prefix that very many conversations share are summed by partial
aggregates and meet its figures in a join of two plain tables, which adaptive execution
splits. A conversation is one chain, so its turns stream through one task, which keeps one
row; so do the ids that a node's digest lists, in ascending order.

Defined cases: null role or text is empty; null turns come first, and turns of one number
are ordered by their digest; repeated rows are turns of their own; rows with null conv_id
are left out; an empty table has no node, not even the root; other columns are ignored;
texts may be of any length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionrec.functions.order import hot_groups, positions
from sessionrec.llm.sketch import Sketch
from sessionrec.sources.stages import materialize

FAMILY = 100  # conversations c - c % FAMILY give the first turns
HEADS = 6  # of which there are fewer than this
DIGEST = 16
PROBES = 2
_ROWS = 8192

PATHS = "conv_id long, depth long, digest binary, h long, next_h long, code_points long, total long"


def own_turns(conv_id: Column) -> Column:
    """How many first turns of a conversation are replaced."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, t (digest of role and text), code_points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, DIGEST).alias("t"),
        F.length(text).cast("bigint").alias("code_points"),
    )


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """conv_id, side, position, t, code_points, total of every rebuilt conversation.

    Side 0 is one row per conversation with its number of turns, side 1 the turns of its
    family's first conversation, side 2 its own.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("t").asc()]
    numbered = positions(turns, ["conv_id"], order, "position", hot_groups(turns, ["conv_id"]))
    numbered = materialize(numbered.select("conv_id", "position", "t", "code_points"), "trie-turns")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = numbered.groupBy("conv_id").agg((F.max("position") + 1).alias("n"))
    sizes = materialize(sizes, "trie-conversations")
    heads = numbered.filter((base == F.col("conv_id")) & (F.col("position") < HEADS - 1)).select(
        F.col("conv_id").alias("base"), "position", "t", "code_points"
    )
    roots = sizes.select("conv_id", "n", base.alias("base"), own_turns(F.col("conv_id")).alias("h")).join(
        sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left"
    )
    total = F.least("h", F.coalesce("n_base", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    nothing, none = F.lit(None).cast("binary"), F.lit(None).cast("bigint")
    first = roots.select("conv_id", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("position"), nothing.alias("t"), none.alias("code_points"), total.alias("total"))
    given = roots.join(heads, "base").filter("position < h").select(
        "conv_id", F.lit(1).alias("side"), "position", "t", "code_points", none.alias("total")
    )
    own = numbered.filter(F.col("position") >= own_turns(F.col("conv_id"))).select(
        "conv_id", F.lit(2).alias("side"), "position", "t", "code_points", none.alias("total")
    )
    return first.union(given).union(own)


def prefix_paths(rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and depth: digest of the prefix, h and next_h (64 bits of
    its and the next prefix's digest), code points of its last text, turns of the whole."""
    names = [part.split()[0] for part in PATHS.split(", ")]
    root = bytes(DIGEST)
    rows_out = _ROWS

    def chain(batches):
        held, out = None, []  # the row whose next one is not known yet

        def flush():
            columns = list(zip(*out)) if out else [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for conv, t, size, total in zip(*(batch[n].to_pylist() for n in ("conv_id", "t", "code_points", "total"))):
                if t is None:
                    if held is not None:
                        out.append(held)
                    held = (conv, 0, root, 0, None, 0, total)
                else:
                    digest = hashlib.blake2b(held[2] + t, digest_size=len(root)).digest()
                    h = int.from_bytes(digest[:8], "little", signed=True)
                    out.append((*held[:4], h, *held[5:]))
                    held = (conv, held[1] + 1, digest, h, None, size, held[6])
            if len(out) >= rows_out:
                yield flush()
        if held is not None:
            out.append(held)
        yield flush()

    dealt = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "side", "position")
    return dealt.mapInArrow(chain, PATHS)


def listed_ids(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256: SHA-256 of the ids that end at a node, ascending, comma-joined."""

    def run(batches):
        held, state = None, None
        for batch in batches:
            found, hashed = [], []
            digests, ids = batch["digest"].to_pylist(), batch["conv_id"].to_pylist()
            at = 0
            while at < len(ids):
                stop = at
                while stop < len(ids) and digests[stop] == digests[at]:
                    stop += 1
                text = ",".join(map(str, ids[at:stop])).encode()
                if digests[at] == held:
                    state.update(b"," + text)
                else:
                    if held is not None:
                        found.append(held)
                        hashed.append(state.hexdigest())
                    held, state = digests[at], hashlib.sha256(text)
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(hashed, pa.string())], ["digest", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    dealt = ends.select("digest", "conv_id").repartition("digest").sortWithinPartitions("digest", "conv_id")
    return dealt.mapInArrow(run, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 of every distinct prefix; conversations as ``rebuilt_turns`` makes them."""
    paths = materialize(prefix_paths(rebuilt_turns(turn_digests(conversations))), "trie-paths")
    sketch = Sketch(paths.count(), PROBES, rows=True)
    repeated = sketch.repeated(paths, sketch.build(paths.filter("depth > 0"), "h"))
    has_next = F.col("next_h").isNotNull()
    known = paths.withColumn("shared", (F.col("depth") == 0) | repeated("h")).withColumn(
        "single_next", has_next & ~repeated("next_h")
    )
    # A proven node under a proven node: its parent's smallest member is its own.
    local = known.filter("single_next and not shared").select(
        "conv_id", F.col("depth") + 1, F.col("conv_id").alias("parent_conv_id"), "total"
    )
    shared = known.filter("shared").select(
        "conv_id", "depth", "digest", "code_points", "total", "single_next", has_next.alias("has_next")
    )
    shared = materialize(shared, "trie-shared")
    node = ["depth", "digest"]
    stats = shared.groupBy(*node).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("total").alias("longest")
    )
    met = shared.join(materialize(stats, "trie-stats"), node)

    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = F.col("owner") == F.col("conv_id")
    below, above = F.lag(F.struct("depth", "owner")).over(up), F.lead(F.struct("depth", "owner")).over(up)
    owns_next = F.when(F.col("single_next"), True).otherwise(
        F.coalesce((below["depth"] == F.col("depth") + 1) & (below["owner"] == F.col("conv_id")), F.lit(False))
    )
    parent = F.when(F.col("depth") > 0, F.when(above["depth"] == F.col("depth") - 1, above["owner"]).otherwise(F.col("conv_id")))
    # The deepest row kept: where it is not the last turn, the rest is proven and has a leaf.
    leaf = F.when(F.col("depth") < F.col("total"), True).otherwise(owned & (F.col("longest") == F.col("depth")))
    worth = F.when(owned, (F.col("n_convs") - 1) * F.col("code_points")).otherwise(0)
    walked = met.select(
        "conv_id", *node, "total", "single_next", "owner", "n_convs",
        parent.alias("parent_conv_id"),
        (F.col("has_next") & owns_next).cast("bigint").alias("child"),
        F.first(leaf.cast("bigint")).over(so_far).alias("leaf"),
        F.sum(worth).over(so_far).alias("saved"),
    )
    walked = materialize(walked, "trie-walked")
    nodes = walked.groupBy(*node).agg(
        F.min("owner").alias("conv_id"),
        F.min("parent_conv_id").alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = listed_ids(walked.filter("depth = total"))
    no_ids = F.sha2(F.lit("").cast("binary"), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = nodes.join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", no_ids))
    heads = walked.filter("single_next").select("conv_id", F.col("depth") + 1, F.col("owner").alias("parent_conv_id"), "total")
    one, ends_here = F.lit(1).cast("bigint"), F.col("depth") == F.col("total")
    alone = local.union(heads).toDF("conv_id", "depth", "parent_conv_id", "total").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        one.alias("n_convs"),
        F.when(ends_here, 0).otherwise(1).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(ends_here, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(no_ids).alias("ends_sha256"),
    )
    return nodes.select(*columns).union(alone)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
with turns as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (
               partition by conv_id order by turn nulls first,
               sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))
           ) as pos
    from conversations where conv_id is not null
), ids as (
    select c, c - c % 100 as base, xor(4294967295, list_reduce(
        list_concat([4294967295], flatten(list_transform(
            string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end
    )) % 6 as h
    from (select distinct c from turns)
), rebuilt as (
    select ids.c, 1 as side, pos, role, text from ids join turns on turns.c = ids.base and pos <= h
    union all
    select ids.c, 2, pos, role, text from ids join turns on turns.c = ids.c and pos > h
), paths as (
    select c, 0::bigint as d, '' as k, 0 as points from ids
    union all
    select c, row_number() over w, sha256(string_agg(length(role)::varchar || ':' || role || length(text)::varchar || ':' || text, '') over w), length(text)
    from rebuilt window w as (partition by c order by side, pos rows unbounded preceding)
), totals as (
    select c, max(d) as total from paths group by c
), nodes as (
    select d, k, min(c) as conv_id, count(*) as n_convs, max(total) as longest, (count(*) - 1) * max(points) as worth,
           coalesce(string_agg(c::varchar, ',' order by c) filter (total = d), '') as ends
    from paths join totals using (c) group by d, k
), above as (
    select n.d, n.k, p.k as parent from nodes n join paths p on p.c = n.conv_id and p.d = n.d - 1
), children as (
    select d - 1 as d, parent as k, count(*) as n_children from above group by 1, 2
), below as (
    select p.d, p.k, sum(n.worth) as saved, count(*) filter (n.longest = n.d) as leaves
    from nodes n join paths p on p.c = n.conv_id and p.d <= n.d group by 1, 2
)
select n.conv_id, n.d as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
       leaves as n_leaves, saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join below using (d, k) left join children using (d, k)
left join above on above.d = n.d and above.k = n.k
left join nodes up on up.d = n.d - 1 and up.k = above.parent
"""
