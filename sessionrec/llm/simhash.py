"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; two fingerprints link at ``distance`` or fewer differing bits.
Split into ``segments`` on a ring, a linked pair must have a segment from which every
chain of consecutive segments keeps within its share of the budget: a chain of l segments
differs in at most l x distance / segments bits. A chain's share under one bit means equal
segments, so linked pairs agree in segments - distance whole segments; those are the join
keys. The chain test then runs on the joined pairs, before the full Hamming distance.

Exact copies share a fingerprint and are handled once. Buckets of many different
fingerprints that share a key, as a large group of near copies makes, are not paired:
each of their fingerprints is instead listed under the 65 values within one bit of it.
All fingerprints under one value are within two bits of each other, two within two bits
share a value, and no value has more than 65, so linking each to the smallest of its
value loses no link and costs the same per fingerprint whatever the bucket holds.

Defined cases: null text is empty; an empty text, or one of white space, has fingerprint
zero and links like any other; a component is named by its smallest non-null doc_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sessionrec.llm.common import documents, texts
from sessionrec.llm.components import components
from sessionrec.sources.stages import materialize

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
DISTANCE = 2
SEGMENTS = 4
# Fingerprints in a bucket that are still paired with each other.
PAIRED = 64
_PART = 1 << 16


def hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every word shingle of the lower-cased text, repeats included."""
    # bytes.lower() and bytes.split() touch ASCII only.
    found = text.encode().lower().split()
    if len(found) <= words:
        shingles = [b" ".join(found)] if found else []
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    return np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    values = hashes(text, words)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), _PART):
        part = values[at : at + _PART]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp (bigint) of every document."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t, words) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(values, pa.int64())], ["doc_id", "fp"]
            )

    return texts(docs, id_col).mapInArrow(run, "doc_id long, fp long")


def segment_masks(segments: int) -> list[int]:
    """Masks of consecutive bit segments, as signed integers."""
    masks = []
    for i in range(segments):
        low, high = i * BITS // segments, (i + 1) * BITS // segments
        mask = ((1 << (high - low)) - 1) << low
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def chain_test(differing: Column, distance: int, segments: int) -> Column:
    """Some segment starts only chains that stay within their share of ``distance``."""
    d = [F.bit_count(differing.bitwiseAND(F.lit(m))) for m in segment_masks(segments)]
    starts = F.lit(False)
    for i in range(segments):
        ring, held = F.lit(0), F.lit(True)
        for length in range(1, segments + 1):
            ring = ring + d[(i + length - 1) % segments]
            held = held & (ring <= F.lit(length * distance // segments))
        starts = starts | held
    return starts


def bucket_keys(fp: Column, distance: int, segments: int) -> Column:
    """One key for each choice of segments - distance segments."""
    masks = segment_masks(segments)
    keys = []
    for i, chosen in enumerate(combinations(range(segments), segments - distance)):
        mask = 0
        for c in chosen:
            mask |= masks[c]
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("value")))
    return F.array(*keys)


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp``: enough links for their components.

    Every pair within ``distance`` is joined by a path of the links given.
    """
    if distance not in (1, 2):
        raise ValueError("large buckets are linked exactly for a distance of one or two bits")
    keyed = nodes.select("fp", F.explode(bucket_keys(F.col("fp"), distance, segments)).alias("key"))
    keyed = keyed.select("fp", "key.choice", "key.value")
    sizes = materialize(
        keyed.groupBy("choice", "value").agg(F.count("*").alias("n")).filter("n > 1"), "buckets"
    )
    held = materialize(keyed.join(sizes, ["choice", "value"]), "keyed")
    small = held.filter(F.col("n") <= paired).drop("n")
    pair = small.join(small.withColumnRenamed("fp", "other"), ["choice", "value"]).filter("fp < other")
    differing = F.col("fp").bitwiseXOR(F.col("other"))
    pairs = (
        pair.filter(chain_test(differing, distance, segments))
        .filter(F.bit_count(differing) <= distance)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowded = held.filter(F.col("n") > paired).select("fp").distinct()
    return pairs.union(near_links(crowded, distance))


def near_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints through values within one bit; exact for one and two bits."""
    flips = [F.lit((1 << b) - ((1 << BITS) if b == BITS - 1 else 0)) for b in range(BITS)]
    if distance == 1:
        value = nodes.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("b"))
        there = value.join(nodes.select(F.col("fp").alias("b")), "b", "left_semi")
        return there.select(F.col("fp").alias("a"), "b")
    value = nodes.select(
        "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(f) for f in flips])).alias("value")
    )
    # At most 65 fingerprints have a value within one bit.
    members = value.groupBy("value").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    star = members.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return star.filter("a > b").distinct()


def simhash_components(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
    paired: int = PAIRED,
    id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, fp, component_id of every document; ``id_col`` gives the ids."""
    table = materialize(fingerprints(docs, words, id_col), "fingerprints")
    nodes = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes, distance, segments, paired))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = materialize(named, "named")
    smallest = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "classes")
    by_fp = materialize(named.join(smallest, "component").select("fp", "component_id"), "by-fingerprint")
    return table.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
