"""Event logs derived from the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.sources.events import as_events

# Fixed value: labels are the events from this day on.
SPLIT_DAY = "2024-01-24 00:00:00"


def _seconds(ts: str) -> str:
    return f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"


def _clicks(raw: DataFrame) -> DataFrame:
    return as_events(
        raw.select(
            F.col("user_id").alias("session"),
            F.get_json_object("props", "$.k").alias("aid"),
            F.expr(_seconds("ts")).alias("ts"),
            F.expr(
                "CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END"
            ).alias("type"),
            F.col("event_id").alias("eid"),
        )
    )


def _raw_events(spark: SparkSession, sf_dir: str, errors: bool = False) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw if errors else raw.filter("event_type <> 'error'")


def all_events(spark: SparkSession, sf_dir: str, errors: bool = False) -> DataFrame:
    """The log without events of kind error, which are no interactions; or the whole log."""
    return _clicks(_raw_events(spark, sf_dir, errors))


def train_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before the split; the filter reaches the parquet scan."""
    raw = _raw_events(spark, sf_dir)
    return _clicks(raw.filter(F.col("ts") < F.expr(f"timestamp_ntz'{SPLIT_DAY}'")))


def later_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the split on."""
    raw = _raw_events(spark, sf_dir)
    return _clicks(raw.filter(F.col("ts") >= F.expr(f"timestamp_ntz'{SPLIT_DAY}'")))


def test_events(spark: SparkSession, sf_dir: str, train: DataFrame | None = None) -> DataFrame:
    """Visible history of the sessions that go on after the split; from ``train`` if it is at hand."""
    later = later_events(spark, sf_dir).select("session").distinct()
    train = train_events(spark, sf_dir) if train is None else train
    return train.join(later, "session", "left_semi")


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as delivered: one list of distinct later items per session and type name."""
    later = later_events(spark, sf_dir)
    name = F.expr("CASE type WHEN 0 THEN 'clicks' WHEN 1 THEN 'carts' ELSE 'orders' END")
    return (
        later.select("session", name.alias("type"), "aid")
        .groupBy("session", "type")
        .agg(F.array_sort(F.collect_set("aid")).alias("ground_truth"))
    )


def basket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer baskets as sessions: larger catalogue, many equal time stamps.

    Line numbers repeat within an order, so ties are broken by item and type.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return as_events(
        joined.select(
            F.col("o_custkey").alias("session"),
            F.col("l_partkey").alias("aid"),
            F.expr(_seconds("cast(o_orderdate as timestamp_ntz)")).alias("ts"),
            kind.alias("type"),
        )
    )


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors: one per ``vec_id``."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return raw.select(F.col("vec_id").cast("int").alias("aid"), F.col("embedding").alias("vec"))
