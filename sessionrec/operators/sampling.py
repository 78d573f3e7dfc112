"""Negative down-sampling and row order of the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionrec.sources.events import TARGETS


def _kept(ratio: float, *salted):
    """Repeatable draw: first 32 bits of an md5 against the ratio; 1 keeps every row."""
    if ratio >= 1:
        return F.lit(True)
    threshold = "%08x" % int(ratio * 2**32)
    digest = F.md5(F.concat_ws(":", *salted))
    return F.substring(digest, 1, 8) < F.lit(threshold)


def is_positive():
    """A row with any target."""
    return F.greatest(*[F.col(f"target_{n}") for n in TARGETS]) == 1


def sample_negatives(pairs: DataFrame, ratio: float = 0.5, seed: int = 77) -> DataFrame:
    """All positives and a share of the negatives.

    The draw is a hash of the row's key: the same rows on every run and every retry.
    """
    return pairs.filter(is_positive() | _kept(ratio, "session", "aid", F.lit(seed)))


def shuffle_in_session(pairs: DataFrame, seed: int = 77) -> DataFrame:
    """Random but repeatable order inside each session, as column ``position``."""
    draw = F.md5(F.concat_ws(":", "session", "aid", F.lit(seed)))
    window = Window.partitionBy("session").orderBy(draw)
    return pairs.withColumn("position", F.row_number().over(window))
