"""Least-squares line and moments of every usage series in one aggregation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.operators.usage import first_whole_day, minute_index, since
from seatmeter.schemas import SERIES_KEY


def fit_columns(x, y, clock):
    """Aggregates of a fit of y over x; all keep fixed-width buffers, so they hash and pre-aggregate.

    x counts days from a fixed date. A shift of x leaves slope and R² alone, so no pass is needed to
    find the first day of each series; finish_fit() moves the intercept there.
    """
    return [
        F.count(y).alias("samples"),
        F.regr_slope(y, x).alias("raw_slope"),
        F.regr_intercept(y, x).alias("raw_intercept"),
        F.regr_r2(y, x).alias("raw_r2"),
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("stddev"),
        F.var_pop(y).alias("variance"),
        F.min(x).alias("first_x"),
        F.max(x).alias("last_x"),
        F.max_by(y, clock).alias("last_value"),
        F.min(y).alias("least"),
        F.max(y).alias("most"),
    ]


def finish_fit(fitted: DataFrame) -> DataFrame:
    """Guards: one distinct x gives slope 0 through the mean; constant y gives R² 0."""
    slope = F.coalesce("raw_slope", F.lit(0.0))
    intercept = F.coalesce(F.col("raw_intercept") + F.col("raw_slope") * F.col("first_x"), F.col("mean"))
    r2 = F.when(F.col("variance") == 0, 0.0).otherwise(F.coalesce("raw_r2", F.lit(0.0)))
    kept = [c for c in fitted.columns if not c.startswith("raw_") and c not in ("first_x", "last_x", "variance")]
    return fitted.select(
        *kept,
        slope.alias("slope"),
        intercept.alias("intercept"),
        F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0)).alias("r_squared"),
        (F.col("last_x") - F.col("first_x")).alias("last_day"),
    )


def fit_series(usage: DataFrame, as_of: datetime, days: int, min_samples: int = 1,
               server: str | None = None, feature: str | None = None) -> DataFrame:
    """Fit per series over the whole days of the period; x is days since the series' first sample."""
    start = first_whole_day(as_of, days)
    rows = since(usage, start, server, feature)
    x = F.datediff("date", F.lit(start))
    fitted = rows.groupBy(*SERIES_KEY).agg(
        *fit_columns(x, F.col("users_count"), minute_index(F.col("date"), F.col("time")))
    )
    return finish_fit(fitted.where(F.col("samples") >= min_samples))
