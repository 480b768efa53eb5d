"""Weekly profile, denial counts, and changes between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.schemas import POOL_KEY, SERIES_KEY


def weekly_profile(usage: DataFrame) -> DataFrame:
    """Mean and peak per series, weekday (0 = Sunday) and hour."""
    return usage.groupBy(
        *SERIES_KEY, (F.dayofweek("date") - 1).alias("day_of_week"), m.sample_hour(F.col("time")).alias("hour")
    ).agg(F.avg("users_count").alias("avg_usage"), F.max("users_count").alias("peak_usage"))


def weekday_weekend(usage: DataFrame) -> DataFrame:
    """Mean use on working days and on weekends per series."""
    on_weekend = F.dayofweek("date").isin(1, 7)
    return usage.groupBy(*SERIES_KEY).agg(
        F.avg(F.when(~on_weekend, F.col("users_count"))).alias("weekday_avg"),
        F.avg(F.when(on_weekend, F.col("users_count"))).alias("weekend_avg"),
    )


def denials(events: DataFrame) -> DataFrame:
    """Denied requests per feature, reason and day."""
    return events.where(F.col("event_type") == "DENIED").groupBy("feature_name", "reason", "event_date").agg(
        F.count(F.lit(1)).alias("denials"))


def feature_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pools that appeared, disappeared or changed counts between two inventories."""
    def keyed(rows: DataFrame, suffix: str) -> DataFrame:
        key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in POOL_KEY]
        return rows.select(*key, F.col("total_licenses").alias(f"total_{suffix}"),
                           F.col("used_licenses").alias(f"used_{suffix}"))

    both = keyed(before, "before").join(keyed(after, "after"), POOL_KEY, "full")
    change = (
        F.when(F.col("total_before").isNull(), "added").when(F.col("total_after").isNull(), "removed")
        .when((F.col("total_before") != F.col("total_after")) | (F.col("used_before") != F.col("used_after")),
              "changed")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())
