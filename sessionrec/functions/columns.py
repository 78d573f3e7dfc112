"""Column expressions: pair weights, dates, vectors, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionrec.sources.events import DAY

# Scale of the pair weights and of the recency weights.
HALF_LIFE_SECONDS = 3600.0
MAX_GAP_SECONDS = 7 * DAY
RECENCY_LENGTH = 17
RECENCY_STEP = 0.05  # 1.0 down to 0.2 over 17 places


def time_decay(a: Column, b: Column) -> Column:
    """Halves with every hour between two events."""
    return F.pow(F.lit(2.0), -F.abs(a - b) / HALF_LIFE_SECONDS)


def popularity_damping(count_a: Column, count_b: Column) -> Column:
    product = count_a.cast("double") * count_b.cast("double")
    return 1.0 / F.ln(F.sqrt(product + 2.0))


def trend(newest: Column, ts: Column) -> Column:
    return 1.0 / (newest - ts + 1)


def session_size_damping(events: Column) -> Column:
    return 1.0 / F.ln(1.0 + events)


def gap_damping(gap: Column) -> Column:
    """Decreases slowly up to a week."""
    return 1.0 / (1.0 + F.log1p(F.least(gap, F.lit(MAX_GAP_SECONDS)) / MAX_GAP_SECONDS))


def standardize(value: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(value - mean, std)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def bpr_loss(positive: Column, negative: Column, gamma: float = 1e-10) -> Column:
    """-log(gamma + sigmoid(positive - negative)) of one example."""
    return -F.ln(gamma + 1.0 / (1.0 + F.exp(negative - positive)))

