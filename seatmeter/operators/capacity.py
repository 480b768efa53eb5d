"""Utilization with trend, capacity classes, and the summary of the capacity report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.functions.texts import CAPACITY_CLASSES, advice
from seatmeter.operators.fit import finish_fit, fit_columns
from seatmeter.operators.inventory import series_capacity
from seatmeter.operators.stats import unfold_advice
from seatmeter.operators.usage import first_day, first_whole_day, minute_index, since
from seatmeter.schemas import SERIES_KEY

MIN_SAMPLES = 7


def utilization_with_trend(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30,
                           server: str | None = None) -> DataFrame:
    """Statistics and slope of every series from one pass over the samples.

    Means and peaks include the cutoff's own day, the fit does not: its inputs are NULL on that day.
    Short series keep slope 0. The days to capacity start from the last sample, not from the line.
    """
    start = first_whole_day(as_of, days)
    rows = since(usage, first_day(as_of, days), server)
    in_fit = F.col("date") >= F.lit(start)
    x = F.when(in_fit, F.datediff("date", F.lit(start)))
    y = F.when(in_fit, F.col("users_count"))
    clock = F.when(in_fit, minute_index(F.col("date"), F.col("time")))
    fitted = finish_fit(rows.groupBy(*SERIES_KEY).agg(
        *fit_columns(x, y, clock), F.avg("users_count").alias("avg_usage"), F.max("users_count").alias("peak_usage"),
    ))
    total = F.col("total_licenses")
    enough = F.col("samples") >= MIN_SAMPLES
    expected = F.col("slope") * F.col("last_day") + F.col("last_value")
    reach = F.when(enough, m.days_to_capacity(F.col("slope"), total, expected)).otherwise(-1)
    return (
        fitted.join(series_capacity(features), SERIES_KEY, "left")
        .select(
            *SERIES_KEY, "total_licenses", "avg_usage", "peak_usage",
            m.mean_percent_of(F.col("avg_usage"), total).alias("utilization_pct"),
            F.when(enough, F.col("slope")).otherwise(0.0).alias("trend_slope"), reach.alias("days_to_capacity"),
        )
        .orderBy(F.col("avg_usage").desc(), *SERIES_KEY)
    )


def capacity_classes(trended: DataFrame) -> DataFrame:
    """One row per (class, series); a series may be in one utilization class and one trend class."""
    pct, slope = F.col("utilization_pct"), F.col("trend_slope")

    def entry(name: str):
        return F.struct(F.lit(name).alias("capacity_class"), F.lit(CAPACITY_CLASSES[name]).alias("recommendation"))

    level = F.when(pct >= 80, entry("high_utilization")).when(pct <= 20, entry("low_utilization"))
    trend = F.when(slope > 0.5, entry("trending_up")).when(slope < -0.5, entry("trending_down"))
    unfolded = trended.withColumn("entry", F.explode(F.array_compact(F.array(level, trend))))
    return unfolded.select("entry.*", *trended.columns)


def capacity_summary(trended: DataFrame, days: int = 30) -> DataFrame:
    pct, slope = F.col("utilization_pct"), F.col("trend_slope")
    # Two steps, so that servers are counted without a second copy of every row.
    per_server = trended.groupBy("server_hostname").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(pct >= 80).alias("high"), F.count_if(pct <= 20).alias("low"),
        F.count_if(slope > 0.5).alias("up"), F.count_if(slope < -0.5).alias("down"),
    )

    def added(name: str):
        return F.coalesce(F.sum(name), F.lit(0))

    return per_server.agg(
        F.lit(days).alias("period_analyzed"), F.count(F.lit(1)).alias("total_servers"),
        added("features").alias("total_features"), added("high").alias("features_at_capacity"),
        added("low").alias("features_underutilized"), added("up").alias("features_trending_up"),
        added("down").alias("features_trending_down"),
    )


def capacity_recommendations(summary: DataFrame) -> DataFrame:
    high, low, up = F.col("features_at_capacity"), F.col("features_underutilized"), F.col("features_trending_up")
    rules = [
        (high > 0, advice("many_at_capacity", high)), (low > 0, advice("many_underused", low)),
        (up > 0, advice("many_growing", up)),
    ]
    return unfold_advice(summary, ["period_analyzed"], rules)
