"""Reads of the usage time series: history, statistics, hour-of-day profile, appends."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.operators.inventory import first_seen_samples, series_capacity
from seatmeter.schemas import SAMPLE_KEY, SERIES_KEY
from seatmeter.session import attach, settle

# The selectable periods and their days, for charts, the heatmap page and the prediction page.
PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365}
HEATMAP_DAYS = {"7d": 7, "30d": 7, "90d": 14, "1y": 30}
PREDICTION_DAYS = {"30d": 30, "90d": 90, "1y": 365}


def first_day(as_of: datetime, days: int) -> date:
    """First date of a period that includes the day of the cutoff."""
    return (as_of - timedelta(days=days)).date()


def first_whole_day(as_of: datetime, days: int) -> date:
    """First date whose midnight is not before the cutoff moment: the cutoff's own day drops out."""
    cutoff = as_of - timedelta(days=days)
    return cutoff.date() if cutoff.time() == time.min else cutoff.date() + timedelta(days=1)


def since(usage: DataFrame, day: date, server: str | None = None, feature: str | None = None) -> DataFrame:
    """Samples from `day` on; a literal date, so it prunes partitions and reaches the file scan."""
    rows = usage.where(F.col("date") >= F.lit(day))
    if server:
        rows = rows.where(F.col("server_hostname") == server)
    if feature:
        rows = rows.where(F.col("feature_name") == feature)
    return rows


def samples_from_polls(polls: DataFrame) -> DataFrame:
    """One sample per (server, feature, minute) of a poll log; the first poll of a minute counts."""
    samples = polls.select(
        "poll_id", "server_hostname", "feature_name", F.to_date("sampled_at").alias("date"),
        m.minute_text(F.col("sampled_at")).alias("time"), F.col("used_licenses").alias("users_count"),
    )
    return first_seen_samples(samples, SAMPLE_KEY, "poll_id", ["users_count"]).select(
        F.col("poll_id").alias("id"), *SAMPLE_KEY, "users_count"
    )


def append_usage(existing: DataFrame, batch: DataFrame, from_day: date | None = None) -> DataFrame:
    """The samples of `batch` that are new; `from_day`, its first date, prunes the stored partitions.

    The batch is the small side: its keys pick the stored rows that matter, so the stored table is not
    shuffled unless the batch itself is large.
    """
    stored = existing.where(F.col("date") >= F.lit(from_day)) if from_day else existing
    fresh = settle(first_seen_samples(batch, SAMPLE_KEY, "id", ["users_count"]))
    seen = attach(stored.select(*SAMPLE_KEY), fresh.select(*SAMPLE_KEY), SAMPLE_KEY, "left_semi", settled=True)
    return fresh.join(seen, SAMPLE_KEY, "left_anti").select("id", *SAMPLE_KEY, "users_count")


def usage_history(usage: DataFrame, as_of: datetime, days: int = 7, server: str | None = None,
                  feature: str | None = None) -> DataFrame:
    return (
        since(usage, first_day(as_of, days), server, feature)
        .orderBy("date", "time", *SERIES_KEY)
        .select(*SERIES_KEY, m.sample_timestamp(F.col("date"), F.col("time")).alias("timestamp"), "users_count")
    )


def usage_rows(usage: DataFrame, as_of: datetime, days: int = 30, server: str | None = None,
               feature: str | None = None) -> DataFrame:
    """Stored rows of a series, newest first, from the first whole day of the period on."""
    rows = since(usage, first_whole_day(as_of, days), server, feature)
    return rows.orderBy(F.col("date").desc(), F.col("time").desc(), *SERIES_KEY)


def usage_stats(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30,
                server: str | None = None) -> DataFrame:
    """Mean, peak and least use per series with its license total, NULL when the inventory lacks it."""
    stats = since(usage, first_day(as_of, days), server).groupBy(*SERIES_KEY).agg(
        F.avg("users_count").alias("avg_usage"),
        F.max("users_count").alias("peak_usage"),
        F.min("users_count").alias("min_usage"),
    )
    return (
        stats.join(series_capacity(features), SERIES_KEY, "left")
        .withColumn("avg_utilization_pct", m.mean_percent_of(F.col("avg_usage"), F.col("total_licenses")))
        .orderBy(F.col("avg_usage").desc(), *SERIES_KEY)
    )


def hourly_profile(usage: DataFrame) -> DataFrame:
    """Mean and peak per series and hour, for hours that have samples."""
    return usage.groupBy(*SERIES_KEY, m.sample_hour(F.col("time")).alias("hour")).agg(
        F.avg("users_count").alias("avg_usage"), F.max("users_count").alias("peak_usage")
    )


def hourly_heatmap(usage: DataFrame, as_of: datetime, days: int = 7, server: str | None = None) -> DataFrame:
    """24 rows per series, zero where an hour has no sample. At most 24 profile rows gather per series."""
    profile = hourly_profile(since(usage, first_day(as_of, days), server))
    cell = F.struct("hour", F.struct("avg_usage", "peak_usage"))
    by_series = profile.groupBy(*SERIES_KEY).agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    found = F.try_element_at("cells", F.col("hour"))
    return by_series.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        *SERIES_KEY, "hour",
        F.coalesce(found["avg_usage"], F.lit(0.0)).alias("avg_usage"),
        F.coalesce(found["peak_usage"], F.lit(0)).alias("peak_usage"),
    )


def heatmap_documents(usage: DataFrame, as_of: datetime, days: int = 7, server: str | None = None) -> DataFrame:
    """The heatmap with the 24 hours of a series in one array."""
    rows = hourly_heatmap(usage, as_of, days, server)
    return rows.groupBy(*SERIES_KEY).agg(
        F.array_sort(F.collect_list(F.struct("hour", "avg_usage", "peak_usage"))).alias("hourly_data")
    )


def peak_hour(profile: DataFrame) -> DataFrame:
    """First hour with the largest mean per series; hour 0 when nothing was ever in use."""
    best = profile.groupBy(*SERIES_KEY).agg(
        F.max_by("hour", F.struct("avg_usage", -F.col("hour"))).alias("hour"), F.max("avg_usage").alias("top")
    )
    return best.select(*SERIES_KEY, F.when(F.col("top") > 0, F.col("hour")).otherwise(0).alias("peak_hour"))


def series_comparison(usage: DataFrame, chosen: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """History of the chosen series on one time axis; chosen series without samples drop out.

    A pick of top_series is a limit of at most ten rows, which the planner knows and broadcasts by itself;
    a longer list is joined as its size allows.
    """
    rows = since(usage, first_day(as_of, days)).join(chosen.select(*SERIES_KEY), SERIES_KEY)
    return rows.select(
        *SERIES_KEY, m.sample_timestamp(F.col("date"), F.col("time")).alias("timestamp"), "users_count"
    ).orderBy("timestamp", *SERIES_KEY)


def top_series(utilization: DataFrame, count: int = 3) -> DataFrame:
    """The first series of the utilization order; at most ten can be compared at once."""
    ranked = utilization.groupBy(*SERIES_KEY).agg(F.max("utilization_pct").alias("utilization_pct"))
    order = [F.col("utilization_pct").desc(), F.col("feature_name"), F.col("server_hostname")]
    return ranked.orderBy(*order).limit(min(count, 10)).select(*SERIES_KEY)


def comparison_table(history: DataFrame, series: list[tuple[str, str]]) -> DataFrame:
    """The same history with one column per named series."""
    name = F.concat_ws(":", *SERIES_KEY)
    labels = [":".join(pair) for pair in series]
    named = history.withColumn("series", name)
    return named.groupBy("timestamp").pivot("series", labels).agg(F.max("users_count"))


def minute_index(day: Column, clock: Column) -> Column:
    """Sortable minute number of a sample; a long keeps max_by in a hash aggregation."""
    hours = F.substring(clock, 1, 2).cast("long")
    minutes = F.substring(clock, 4, 2).cast("long")
    return F.unix_date(day).cast("long") * 1440 + hours * 60 + minutes
