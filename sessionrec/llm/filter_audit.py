"""Filter interaction audit: what every order of five quality filters removes, step by step.

Each document gets a mask of the filters it fails. Four are functions of its own text. The
fifth, an exact copy of an earlier document, needs the whole table: a counting Bloom filter
over text hashes clears the texts that are certain to be unique, and only the rest is
grouped by the whole text, where the smallest id is a partial aggregate. One narrow row
per repeated text then joins the masks by id, so no text moves twice.

Counts are additive over masks: documents of a part, by mask. The audit of any order
follows from at most 32 counts per part, so the 120 orders cost nothing in documents. What
a filter removes depends on the set of filters before it alone; those 80 cases are summed
once and listed under their orders, and a filter's Shapley value is their weighted sum.

Defined cases: null text is empty, null source is the part '' (as is an empty source);
a document without a row in ``labels`` is neither good nor toxic, and one with several is
good or toxic if any says so; documents with equal id and text are not copies of each
other; a document with null id is a copy if a row with an id has its text; an empty table
gives an empty result; other columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import SPACE, documents
from sessionrec.llm.sketch import Sketch
from sessionrec.sources.stages import materialize

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
SIGNS = "[#$%&*|]"
PROBES = 2


def own_failures(text: Column) -> list[Column]:
    """Failure conditions of the filters that read one text: A to D."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words = F.size(words)
    return [
        n_words < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n_words,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS_PERCENT * F.length(text),
        text.rlike(SIGNS),
    ]


def document_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask of every document; bit i of ``mask`` is set if filter i fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.xxhash64(text).alias("h"),
    )
    own = F.lit(0)
    for i, fails in enumerate(own_failures(F.col("text"))):
        own = own + F.when(fails, 1 << i).otherwise(0)
    flags = materialize(read.select("doc_id", "part", "h", own.alias("own")), "audit-flags")

    sketch = Sketch(flags.count(), PROBES)
    repeated = sketch.repeated(docs, sketch.build(flags, "h"))
    firsts = (
        read.select("doc_id", "text", "h").filter(repeated("h"))
        .groupBy("text", "h")
        .agg(F.min("doc_id").alias("first"))
        .select("first", F.col("h").alias("first_h"), F.lit(True).alias("is_first"))
    )
    firsts = materialize(firsts.distinct(), "audit-firsts")
    met = flags.withColumn("repeated", repeated("h")).join(
        firsts, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")), "left"
    )
    copy = F.when(F.col("repeated") & F.col("is_first").isNull(), 1 << 4).otherwise(0)
    return met.select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just these filters."""
    marks = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic")
        .filter("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy("doc_id")
        .agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    )
    known = masks.filter("doc_id is not null").join(marks, "doc_id", "left")
    nameless = masks.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step; ``counts`` as from ``mask_counts``."""
    size = len(filters)
    orders: dict[tuple[int, int], list[str]] = {}
    for order in permutations(range(size)):
        for k, f in enumerate(order):
            before = sum(1 << g for g in order[:k])
            orders.setdefault((f, before), []).append("".join(filters[i] for i in order))
    cases = sorted(orders)
    spec = F.array(*[F.struct(F.lit(i).alias("case"), F.lit(f).alias("f"), F.lit(s).alias("before")) for i, (f, s) in enumerate(cases)])
    each = counts.withColumn("spec", F.explode(spec)).select("*", "spec.*")
    bit = F.expr("shiftleft(1, f)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(column: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(column)).otherwise(F.lit(0).cast("bigint")))

    summed = each.groupBy("part", "case", "f", "before").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == bit).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    steps = F.expr("bit_count(before)")
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)]), steps + 1)
    shares = summed.groupBy("part", "f").agg(F.sum(F.col("removed") * times).alias("shapley"))
    listed = F.array(*[F.array(*[F.lit(o) for o in orders[c]]) for c in cases])
    return (
        summed.join(shares, ["part", "f"])
        .withColumn("filter_order", F.explode(F.element_at(listed, F.col("case") + 1)))
        .select(
            "part",
            "filter_order",
            (steps + 1).cast("int").alias("step"),
            *("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"),
        )
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all 120 orders for every source of ``documents``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    masks = document_masks(documents(spark, sf_dir))
    return audit(materialize(mask_counts(masks, labels), "mask-counts"))


ORACLE = r"""
with recursive words as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), firsts as (
    select t, min(doc_id) as first from words group by t
), marks as (
    select doc_id, bool_or(quality is not distinct from 1) as good, bool_or(toxic is not distinct from 1) as toxic
    from labels group by doc_id
), masks as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
           case when len(w) < 50 then 1 else 0 end
           + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
           + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end
           + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
           + case when doc_id > first then 16 else 0 end as mask
    from words join firsts using (t) left join marks using (doc_id)
), counts as (
    select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from masks group by part, mask
), orders as (
    select '' as o union all
    select o || l from orders, unnest(['A', 'B', 'C', 'D', 'E']) as u(l) where not contains(o, l)
), steps as (
    select o as filter_order, s::integer as step, 1 << (ascii(o[s]) - 65) as bit,
           list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) as before
    from orders, range(1, 6) as r(s) where length(o) = 5
), found as (
    select part, filter_order, step, bit,
           sum(case when mask & (bit | coalesce(before, 0)::bigint) = 0 then n else 0 end) as kept,
           sum(case when mask & bit != 0 and mask & coalesce(before, 0)::bigint = 0 then n else 0 end) as removed,
           sum(case when mask & bit != 0 and mask & coalesce(before, 0)::bigint != 0 then n else 0 end) as redundant,
           sum(case when mask = bit then n else 0 end) as unique_fails,
           sum(case when mask & bit != 0 and mask & coalesce(before, 0)::bigint = 0 then good else 0 end) as good_lost,
           sum(case when mask & bit != 0 and mask & coalesce(before, 0)::bigint = 0 then toxic else 0 end) as toxic_lost
    from counts, steps group by all
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from found
"""
