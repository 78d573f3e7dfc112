"""Event logs and labels: explicit schemas, casts, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionrec.functions.order import global_positions
from sessionrec.sources.stages import materialize

# Event type codes.
CLICK, CART, ORDER = 0, 1, 2
LABEL_TYPES = {"clicks": 0, "carts": 1, "orders": 2}
TARGETS = {"click": 0, "cart": 1, "order": 2}

# The five event groups of history candidates and features.
EVENT_GROUPS = {
    "inter": (0, 1, 2),
    "buy": (1, 2),
    "click": (0,),
    "cart": (1,),
    "order": (2,),
}

DAY = 24 * 60 * 60

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("session", T.IntegerType()),
        T.StructField("aid", T.IntegerType()),
        T.StructField("ts", T.LongType()),
        T.StructField("type", T.ByteType()),
        T.StructField("eid", T.LongType()),
    ]
)

LABEL_SCHEMA = T.StructType(
    [
        T.StructField("session", T.IntegerType()),
        T.StructField("type", T.ByteType()),
        T.StructField("ground_truth", T.ArrayType(T.IntegerType())),
    ]
)


def as_events(df: DataFrame) -> DataFrame:
    """Cast a log to the event schema.

    ``eid`` breaks ties between events of one session in the same second. A log
    without it gets one from item and type, which orders all but exact copies.
    """
    if "eid" not in df.columns:
        df = df.withColumn("eid", F.col("aid").cast("long") * 4 + F.col("type"))
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Load an event log from parquet."""
    return as_events(spark.read.parquet(path))


def as_labels(df: DataFrame) -> DataFrame:
    """Cast raw labels; type names become codes, unknown names become an error."""
    code = F.create_map(*[F.lit(x) for kv in LABEL_TYPES.items() for x in kv])
    name = F.col("type")
    return df.select(
        F.col("session").cast("int").alias("session"),
        F.when(code[name].isNotNull(), code[name])
        .otherwise(F.raise_error(F.concat(F.lit("unknown label type "), name)))
        .cast("tinyint")
        .alias("type"),
        F.col("ground_truth").cast("array<int>").alias("ground_truth"),
    )


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Load labels (session, type name, ground truth list) from parquet."""
    return as_labels(spark.read.parquet(path))


def is_type(types: tuple[int, ...]) -> str:
    """SQL condition: the event has one of the types."""
    return f"type IN ({', '.join(map(str, types))})"


def empty_labels(spark: SparkSession) -> DataFrame:
    """Submission mode: no labels, schema kept."""
    return spark.createDataFrame([], LABEL_SCHEMA)


def of_group(events: DataFrame, group: str) -> DataFrame:
    """Events of one event group."""
    return events.filter(F.col("type").isin(list(EVENT_GROUPS[group])))


def train_log(train: DataFrame, test: DataFrame) -> DataFrame:
    """The training log holds the visible history of the evaluated sessions too."""
    return train.unionByName(test)


def max_ts(events: DataFrame):
    """Newest time stamp of a log, as a scalar subquery (no join)."""
    return events.agg(F.max("ts")).scalar()


def recent(events: DataFrame, days: int) -> DataFrame:
    """Events of the trailing window that ends at the newest event."""
    return events.filter(F.col("ts") >= max_ts(events) - days * DAY)


def older(events: DataFrame, days: int) -> DataFrame:
    """The complement: events before the trailing window."""
    return events.filter(F.col("ts") < max_ts(events) - days * DAY)


def eligible_events(train: DataFrame, test: DataFrame, min_events: int = 20) -> DataFrame:
    """Training events of sessions that are long enough or are evaluated."""
    long_enough = (
        train.groupBy("session").count().filter(F.col("count") >= min_events).select("session")
    )
    wanted = long_enough.unionByName(test.select("session")).distinct()
    return train.join(wanted, "session", "left_semi")


def draw_sessions(log: DataFrame, ratio: float, name: str, seed: int = 77) -> DataFrame:
    """Sessions hit by int(sessions x ratio) draws with replacement, each once.

    Sessions are numbered by id, and a draw is a hash of its own number, so a retried task
    draws the same sessions. A null session takes part as any other.
    """
    spark = log.sparkSession
    placed = materialize(
        global_positions(log.select("session").distinct(), [F.col("session").asc()], "place"), "draw-places"
    )
    count = placed.count()
    digest = F.md5(F.concat_ws(":", F.lit(name), F.col("id"), F.lit(seed)))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(max(1, count))
    draws = spark.range(int(count * ratio)).select(place.alias("place"))
    return materialize(placed.join(draws, "place", "left_semi").select("session"), "drawn")


def _of_sessions(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.withColumnRenamed("session", "_wanted"), F.col("session").eqNullSafe(F.col("_wanted")), "left_semi")


def sample_sessions(
    train: DataFrame, test: DataFrame, labels: DataFrame, ratio: float = 0.05, seed: int = 77
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Development sample: sessions drawn with replacement, from the log and the test apart.

    Sampled test sessions stay in the training log as well. A ratio of 1 or more keeps all.
    """
    if ratio >= 1:
        return train, test, labels
    tested = draw_sessions(test, ratio, "test", seed)
    trained = draw_sessions(train, ratio, "train", seed).union(tested)
    return _of_sessions(train, trained), _of_sessions(test, tested), _of_sessions(labels, tested)
