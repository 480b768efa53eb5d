"""One row per key, written as aggregations so that a hot key shrinks on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: list[str], order: str, values: list[str], texts: list[str]) -> DataFrame:
    """The row with the largest `order` per key (last write wins; NULL keys are equal).

    `values` are fixed-width columns. A hash aggregation cannot keep strings in its buffer, so `texts`
    join the grouping of a first pass, which leaves a few rows per key for the second.
    """
    return _per_key(df, key, order, values, texts, F.max, F.max_by)


def earliest_per_key(df: DataFrame, key: list[str], order: str, values: list[str], texts: list[str]) -> DataFrame:
    """The row with the smallest `order` per key (first write wins)."""
    return _per_key(df, key, order, values, texts, F.min, F.min_by)


def _per_key(df, key, order, values, texts, pick, pick_by):
    rows = df.groupBy(*key, *texts).agg(
        *[pick_by(v, order).alias(v) for v in values if v != order], pick(order).alias(order)
    )
    if texts:
        rows = rows.groupBy(*key).agg(
            *[pick_by(v, order).alias(v) for v in [*values, *texts] if v != order], pick(order).alias(order)
        )
    return rows
