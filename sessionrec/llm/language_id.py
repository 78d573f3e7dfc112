"""Language identification by the nearest of several centroids per language.

Texts become hashed counts of letter n-grams (one to three letters, words apart), damped
by 1 + log, weighted by inverse document frequency and scaled to length one. Each
language's vectors are clustered by spherical k-means; a text takes the language of the
centroid with the largest cosine. It is rejected if that cosine is under
``REJECT`` of what the language's own texts have at the low end (the first percentile), so
the distance allowed follows from each language's spread.

The classifier is fitted on at most ``SAMPLE`` labelled texts per language, those with the
smallest hashes; that bound holds for the vectors, document frequencies and centroids.
Predictions read every text whole, in parts of a million characters.

Defined cases: a text that is null or has no letter is ``und`` with score zero, and
rejected; without labelled rows every text is ``und``; ties go to the language that
sorts first; repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionrec.llm.common import documents
from sessionrec.sources.stages import materialize

DIMENSIONS = 1 << 14
SAMPLE = 800
CLUSTERS = 3
ROUNDS = 8
REJECT = 0.2
PART = 1_000_000
ROWS = 128
UNKNOWN = "und"


_KEPT: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> is a letter; made once in a task."""
    if "letters" not in _KEPT:
        points = range(sys.maxunicode + 1)
        _KEPT["letters"] = np.frombuffer(bytes(chr(c).isalpha() for c in points), dtype=np.uint8).astype(bool)
    return _KEPT["letters"]


def ngram_counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Hashed counts of letter n-grams, or None for a text without letters."""
    counts = np.zeros(dimensions, np.int32)
    mask, letters = np.uint32(dimensions - 1), 0
    tail = ""
    text = text or ""
    for at in range(0, len(text), PART):
        # The last two characters of a part begin the n-grams of the next.
        points = np.frombuffer((tail + text[at : at + PART].lower()).encode("utf-32-le", "replace"), np.uint32)
        code = np.where(_letters()[points], points, np.uint32(0))
        letters += int(np.count_nonzero(code))
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code = code[keep]
        skip = 0 if at == 0 else min(2, len(code))
        one = code * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (code[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (code[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for grams, back in ((one[skip:], 0), (two[max(0, skip - 1) :], 1), (three, 2)):
            counts += np.bincount((grams ^ (grams >> np.uint32(15))) & mask, minlength=dimensions).astype(np.int32)
        tail = text[max(0, at + PART - 2) : at + PART].lower()
    return counts if letters else None


@dataclass(frozen=True)
class Model:
    """Fitted on a bounded sample, so its size does not depend on the corpus."""

    languages: list[str]
    idf: np.ndarray  # (dimensions,)
    centroids: np.ndarray  # (clusters, dimensions), length one
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine under which a text is too far from the centroid

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, cosine, rejected) for rows of counts."""
        cosines = weigh(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        cosine = cosines[np.arange(len(best)), best]
        return self.owner[best], cosine, cosine < self.least[best]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one."""
    out = np.zeros(counts.shape, np.float32)
    some = counts > 0
    out[some] = 1 + np.log(counts[some].astype(np.float32))
    out *= idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def cluster(vectors: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the first rows: (centroids, cluster of each row)."""
    centroids = vectors[:clusters]
    member = np.zeros(len(vectors), np.int64)
    for _ in range(rounds):
        member = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[member == c].sum(axis=0) for c in range(len(centroids))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def _counter(dimensions: int):
    """Rows of text, lang and _order to sparse counts, without the texts that have no letter."""

    def count(batches):
        # A few rows at a time, as plain arrays: the sample can arrive in one batch.
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                counts = [ngram_counts(text, dimensions) for text in part["text"].to_pylist()]
                known = [i for i, c in enumerate(counts) if c is not None]
                found = [np.flatnonzero(counts[i]) for i in known]
                none = [np.empty(0, np.int64)]
                at = np.concatenate(none + found).astype(np.int32)
                values = np.concatenate(none + [counts[i][f] for i, f in zip(known, found)]).astype(np.int64)
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["lang"].take(pa.array(known, pa.int64())).cast(pa.string()),
                        part["_order"].take(pa.array(known, pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(at)),
                        pa.ListArray.from_arrays(offsets, pa.array(values)),
                    ],
                    ["lang", "order", "at", "values"],
                )

    return count


def fit(
    labelled: DataFrame,
    order: Column,
    sample: int = SAMPLE,
    clusters: int = CLUSTERS,
    dimensions: int = DIMENSIONS,
    reject: float = REJECT,
) -> Model:
    """Centroids from ``labelled`` (text, lang); ``order`` picks the sample."""
    ranked = Window.partitionBy("lang").orderBy("_order")
    # Narrow rows are ranked, each task keeping its own first ones; texts come after.
    rows = labelled.filter("lang is not null").select("lang", "text", order.alias("_order"))
    limits = (
        rows.select("lang", "_order")
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= sample)
        .groupBy("lang")
        .agg(F.max("_order").alias("_last"))
    )
    # One row per language, as the model has, so texts are filtered where they are read.
    # Repeated rows share a hash and count once, so the sample stays within its bound.
    taken = rows.join(F.broadcast(limits), "lang").filter("_order <= _last").drop("_last")
    taken = taken.dropDuplicates(["lang", "_order"])

    schema = "lang string, order long, at array<int>, values array<bigint>"
    vectors = materialize(taken.mapInArrow(_counter(dimensions), schema), "language-sample")
    total = vectors.count()
    idf = np.full(dimensions, 1 + np.log(1 + total), np.float32)
    # At most one row per dimension.
    for row in vectors.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        idf[row["at"]] = 1 + np.log((1 + total) / (1 + row["count"]))

    def centre(frame):
        frame = frame.sort_values("order")  # rows arrive in any order
        # One dense row per text of the sample, filled in place.
        weighed = np.zeros((len(frame), dimensions), np.float32)
        for i, (at, values) in enumerate(zip(frame["at"], frame["values"])):
            row = (1 + np.log(np.asarray(values, np.float32))) * idf[at]
            weighed[i, at] = row / np.linalg.norm(row)
        centroids, member = cluster(weighed, clusters)
        cosines = np.einsum("ij,ij->i", weighed, centroids[member])
        lang, low = frame["lang"].iloc[0], float(np.quantile(cosines, 0.01))
        out = [
            (lang, c, centroids[c].astype(np.float32).tobytes(), low)
            for c in range(len(centroids))
            if (member == c).any()
        ]
        return pd.DataFrame(out, columns=["lang", "cluster", "centroid", "low"])

    # A language's group is at most ``sample`` sparse vectors; a model is clusters x languages rows.
    found = vectors.groupBy("lang").applyInPandas(centre, "lang string, cluster int, centroid binary, low double")
    centres = sorted(found.collect(), key=lambda r: (r["lang"], r["cluster"]))
    languages = sorted({r["lang"] for r in centres})
    return Model(
        languages,
        idf,
        np.array([np.frombuffer(r["centroid"], np.float32) for r in centres]).reshape(-1, dimensions),
        np.array([languages.index(r["lang"]) for r in centres], np.int64),
        np.array([reject * r["low"] for r in centres]),
    )


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    out = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)})

    def run(batches):
        model = shared.value
        for batch in batches:
            rows = batch.num_rows
            pred, score, rejected = [UNKNOWN] * rows, np.zeros(rows), np.ones(rows, bool)
            for first in range(0, rows if model.languages else 0, ROWS):
                texts = batch[text_col].slice(first, ROWS).to_pylist()
                counts = [ngram_counts(t, len(model.idf)) for t in texts]
                known = [i for i, c in enumerate(counts) if c is not None]
                if not known:
                    continue
                owner, cosine, far = model.predict(np.array([counts[i] for i in known]))
                for i, o, c, f in zip(known, owner, cosine, far):
                    pred[first + i] = model.languages[o]
                    score[first + i] = min(1.0, max(0.0, float(c)))
                    rejected[first + i] = bool(f)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns |= {"lang_pred": pa.array(pred), "score": pa.array(score), "rejected": pa.array(rejected)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return out.mapInArrow(run, out.schema)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo three: 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learned(docs: DataFrame) -> Model:
    """Fitted on the rows that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter(F.coalesce(remainder(F.col("doc_id")) != 1, F.lit(False)))
    return fit(known, F.xxhash64("doc_id"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "text")
    return identify(rows, learned(docs)).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )
