"""Stage tables: parquet hand-over between pipeline stages and lineage cuts.

Everything here writes to the folder named by ``spark.checkpoint.dir`` (or to a
path the caller gives), which executors share, so a lost executor never loses a
stage. Nothing is kept only in executor memory.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


# Paths given out while ``materialize_alone`` builds its table.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="sessionrec-checkpoint-")


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir(spark.sparkContext.applicationId)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for one stage table of this run."""
    path = f"{shared_dir(spark).rstrip('/')}/sessionrec/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def drop_stage(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files of the writes inside go when each write ends: the table replaces them."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


@contextmanager
def joined_in_place(spark: SparkSession):
    """Tables written inside that are dealt by some of a join's keys are not dealt again for it.

    For candidates dealt by session that meet tables by session and item.
    """
    before = spark.conf.get(_ALL_KEYS, "true")
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Persist a stage table as parquet."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_freed(df.sparkSession):
        writer.parquet(path)
    return path


def read_stage(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Re-open a stage table; lazy, so filters and columns reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    Used where a result must be computed exactly once (range partition numbers)
    or where several later plans start from it (item pairs, embeddings).
    """
    spark = df.sparkSession
    schema = df.schema
    path = write_stage(df, stage_path(spark, name))
    return read_stage(spark, path, schema)


def materialize_alone(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written once; stage tables that it wrote on the way are dropped.

    Nothing but the result may read those tables.
    """
    path = stage_path(spark, name)
    made: list[str] = []
    before = _MADE.set(made)
    try:
        df = build()
        schema = df.schema
        write_stage(df, path)
    finally:
        _MADE.reset(before)
        for table in made:
            drop_stage(spark, table)
    return read_stage(spark, path, schema)


class Scratch:
    """Tables of one computation in a folder of their own, dropped once nothing reads them.

    A table may be dropped when every table made from it is written; what is returned to a
    caller must read tables that stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = stage_path(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once under ``name`` and read back."""
        schema = df.schema
        return read_stage(self.spark, write_stage(df, f"{self.folder}/{name}"), schema)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_stage(self.spark, f"{self.folder}/{name}")


def feature_columns(table: DataFrame, keys: tuple[str, ...]) -> list[str]:
    """Feature columns of a table: schema only, no job."""
    return [c for c in table.columns if c not in keys]
