"""Token-id files: documents as coded ids in ascending doc_id order.

Documents are dealt out by ranges of doc_id, encoded by the ``tokenizers`` library and
written in files of whole documents. A file is one binary value: an index with the id and
length of each document, and the ids coded by ``id_coder`` in independent, checksummed
blocks. The values are stored as a Parquet table, so any shared store that Spark can write
will do, and a retried task replaces its own files only. ``part`` and ``seq`` give the
files' order; ``n_ids`` lets a reader place each file without opening it.

Defined cases: null text is empty (its end id alone); null doc_ids come first; repeated
rows are all written; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionrec.llm.common import documents, texts
from sessionrec.llm.id_coder import decode, encode
from sessionrec.llm.packing import vocabulary_path
from sessionrec.llm.tokens import tokenizer
from sessionrec.sources.stages import read_stage, stage_path, write_stage

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
FILE_IDS = 4_000_000

FILE_SCHEMA = "part int, seq int, n_docs long, n_ids long, data binary"
DOC_SCHEMA = "part int, seq int, place int, doc_id long, before long, n_tokens long, ids binary"

_INDEX = "<4sII"
MAGIC = b"IDF1"


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Index (nulls, ids, lengths) with its checksum, then the coded ids."""
    nulls = np.packbits([d is None for d in doc_ids]).tobytes() if doc_ids else b""
    index = nulls + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    return struct.pack(_INDEX, MAGIC, len(doc_ids), zlib.crc32(index)) + index + encode(ids)


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids); raises ValueError where a checksum fails."""
    if len(data) < struct.calcsize(_INDEX) or data[:4] != MAGIC:
        raise ValueError("not a token-id file")
    _, n, crc = struct.unpack_from(_INDEX, data)
    bits = -(-n // 8)
    index = data[struct.calcsize(_INDEX) : struct.calcsize(_INDEX) + bits + 16 * n]
    if len(index) != bits + 16 * n or zlib.crc32(index) != crc:
        raise ValueError("the index is damaged")
    nulls = np.unpackbits(np.frombuffer(index[:bits], np.uint8))[:n]
    numbers = np.frombuffer(index[bits : bits + 8 * n], "<i8")
    lengths = np.frombuffer(index[bits + 8 * n :], "<i8")
    ids = decode(data[struct.calcsize(_INDEX) + len(index) :])
    if len(ids) != lengths.sum():
        raise ValueError("index and ids differ")
    return [None if gone else int(d) for d, gone in zip(numbers, nulls)], lengths, ids


def id_files(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """One row per file; a file ends with the document that brings it to ``file_ids`` ids."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode_text = tokenizer(vocabulary_path(vocabulary)).packed
        part, seq = TaskContext.get().partitionId(), 0
        held, names, lengths, size = [], [], [], 0

        def file():
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [seq], [len(names)], [size], [pack_file(names, lengths, ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds)], ["part", "seq", "n_docs", "n_ids", "data"]
            )

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                packed = encode_text(text) + end
                held.append(packed)
                names.append(doc_id)
                lengths.append(len(packed) // 4)
                size += lengths[-1]
                if size >= file_ids:
                    yield file()
                    seq += 1
                    held, names, lengths, size = [], [], [], 0
        if names:
            yield file()

    # Equal ids with different texts may lie in several ranges; the order stays total.
    tie = F.xxhash64("text")
    ordered = texts(docs).repartitionByRange(F.asc_nulls_first("doc_id"), tie)
    return ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), tie).mapInArrow(run, FILE_SCHEMA)


def write_files(docs: DataFrame, path: str, **options) -> str:
    return write_stage(id_files(docs, **options), path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: DOC_SCHEMA, with ids as little-endian 32-bit integers.

    ``before`` counts the ids of the file's documents before this one.
    """

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch[c].to_pylist() for c in ("part", "seq", "data"))):
                doc_ids, lengths, ids = unpack_file(data)
                ends = np.cumsum(lengths)
                plain = ids.astype("<u4")
                n = len(doc_ids)
                for first in range(0, n, 4096):  # bounded batches of documents
                    some = range(first, min(n, first + 4096))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(some), pa.int32()),
                            pa.array([seq] * len(some), pa.int32()),
                            pa.array(list(some), pa.int32()),
                            pa.array([doc_ids[i] for i in some], pa.int64()),
                            pa.array([int(ends[i] - lengths[i]) for i in some], pa.int64()),
                            pa.array([int(lengths[i]) for i in some], pa.int64()),
                            pa.array([plain[ends[i] - lengths[i] : ends[i]].tobytes() for i in some], pa.binary()),
                        ],
                        ["part", "seq", "place", "doc_id", "before", "n_tokens", "ids"],
                    )

    return read_stage(spark, path).select("part", "seq", "data").mapInArrow(run, DOC_SCHEMA)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, first: the ids of all files before."""
    files = read_stage(spark, path).select("part", "seq", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per write task, then one per file of a task.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    return files.join(parts, "part").select(
        "part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_files(documents(spark, sf_dir), stage_path(spark, "token-files"))
    rows = read_files(spark, path).select(
        "part", "seq", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return rows.join(file_starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
