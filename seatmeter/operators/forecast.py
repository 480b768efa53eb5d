"""Predictions, forecast, anomalies and trend analysis of every series at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.functions.texts import TREND_ACTIONS
from seatmeter.operators.fit import fit_series
from seatmeter.operators.inventory import series_capacity
from seatmeter.operators.usage import first_whole_day, since
from seatmeter.schemas import SERIES_KEY
from seatmeter.session import attach

MIN_SAMPLES = 7


def _expected_now():
    return F.col("slope") * F.col("last_day") + F.col("intercept")


def _fit_with_capacity(usage, features, as_of, days):
    """Series with enough samples that the inventory knows."""
    return fit_series(usage, as_of, days, MIN_SAMPLES).join(series_capacity(features), SERIES_KEY)


def predictive_summary(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return _fit_with_capacity(usage, features, as_of, days).select(
        *SERIES_KEY, "total_licenses", F.col("mean").alias("current_usage"), F.col("slope").alias("trend_slope"),
        m.days_to_capacity(F.col("slope"), F.col("total_licenses"), _expected_now()).alias("days_to_capacity"),
        F.col("r_squared").alias("confidence_level"),
    )


def forecast(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30, horizon: int = 30) -> DataFrame:
    """One row per series and future day. The line runs on from the last sample, the dates from as_of."""
    ahead = _fit_with_capacity(usage, features, as_of, days).withColumn(
        "days_ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    line = F.col("slope") * (F.col("last_day") + F.col("days_ahead")) + F.col("intercept")
    return ahead.select(
        *SERIES_KEY, "days_ahead", F.date_add(F.to_date(m.moment(as_of)), F.col("days_ahead")).alias("date"),
        F.greatest(line, F.lit(0.0)).alias("predicted_usage"), "total_licenses",
    )


def anomalies(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Samples more than two standard deviations from the mean of their series, oldest first.

    Mean and deviation are aggregated first and attached to the samples: a window over the series would
    put a hot series into one task.
    """
    rows = since(usage, first_whole_day(as_of, days))
    moments = rows.groupBy(*SERIES_KEY).agg(
        F.count("users_count").alias("samples"), F.avg("users_count").alias("expected"),
        F.stddev_pop("users_count").alias("stddev"),
    )
    known = (
        moments.where((F.col("samples") >= MIN_SAMPLES) & (F.col("stddev") > 0))
        .join(series_capacity(features), SERIES_KEY).select(*SERIES_KEY, "expected", "stddev")
    )
    z = F.try_divide(F.col("users_count") - F.col("expected"), F.col("stddev"))
    return (
        attach(rows, known, SERIES_KEY)
        .withColumn("deviation", z)
        .where(F.abs("deviation") > 2.0)
        .orderBy("date", "time", *SERIES_KEY)
        .select(*SERIES_KEY, "date", "time", F.col("users_count").alias("usage"), "expected", "deviation",
                m.anomaly_severity(F.col("deviation")).alias("severity"))
    )


def trend_analysis(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Slope, projections, capacity risk and the action each series calls for."""
    slope, total, expected = F.col("slope"), F.col("total_licenses"), _expected_now()
    full = (slope > 0) & (total > 0) & (expected >= total)
    reach = F.col("days_to_capacity")
    near = (reach >= 0) & (reach < 30)
    action = (
        F.when(full, TREND_ACTIONS["full"])
        .when(near, TREND_ACTIONS["near"])
        .when((reach >= 30) & (reach < 90), TREND_ACTIONS["ahead"])
        .when((slope < -0.5) & (total > 0), TREND_ACTIONS["shrinking"])
        .otherwise(TREND_ACTIONS["none"])
    )

    def projected(ahead: int):
        return F.greatest(slope * (F.col("last_day") + ahead) + F.col("intercept"), F.lit(0.0))

    fitted = _fit_with_capacity(usage, features, as_of, days).withColumn(
        "days_to_capacity", m.days_to_capacity(slope, total, expected)
    )
    return fitted.select(
        *SERIES_KEY, F.lit(days).alias("period"), "slope", "intercept", "r_squared",
        m.trend_direction(slope).alias("direction"),
        slope.alias("change_per_day"), (slope * 7).alias("change_per_week"), (slope * 30).alias("change_per_month"),
        projected(7).alias("projected_usage_7_days"), projected(30).alias("projected_usage_30_days"),
        projected(90).alias("projected_usage_90_days"), "days_to_capacity",
        (full | near).alias("capacity_at_risk"), action.alias("recommended_action"),
        m.capacity_warning(reach).alias("capacity_warning"),
    )
