"""Enhanced statistics, efficiency score and recommendations per series."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.functions.texts import advice
from seatmeter.operators.inventory import series_capacity
from seatmeter.operators.usage import first_day, first_whole_day, minute_index, peak_hour, since
from seatmeter.schemas import SERIES_KEY

MIN_SAMPLES = 2


def counted_samples(usage: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """How often each value occurs per series, day and hour: the one pass from which all but the latest samples follow.

    Every reader below groups this same table and selects days inside its aggregates, not by a filter, so that the
    shuffle of the counts is made once and reused.
    """
    rows = since(usage, first_day(as_of, days))
    return rows.groupBy(*SERIES_KEY, "date", m.sample_hour(F.col("time")).alias("hour"), "users_count").agg(
        F.count(F.lit(1)).alias("times"))


def series_median(counts: DataFrame, start: date) -> DataFrame:
    """Exact median per series from `start` on; few rows per series reach the percentile."""
    times = F.sum(F.when(F.col("date") >= F.lit(start), F.col("times"))).alias("times")
    by_value = counts.groupBy(*SERIES_KEY, "users_count").agg(times).where("times > 0")
    return by_value.groupBy(*SERIES_KEY).agg(F.percentile("users_count", 0.5, F.col("times")).alias("median_usage"))


def series_moments(counts: DataFrame, start: date, min_samples: int) -> DataFrame:
    """Mean, spread, extremes and slope per day of each series from `start` on, from weighted sums of whole numbers."""
    inside = F.col("date") >= F.lit(start)
    n = F.when(inside, F.col("times")).cast("double")
    x, y = F.datediff("date", F.lit(start)).cast("double"), F.col("users_count").cast("double")
    sums = counts.groupBy(*SERIES_KEY).agg(
        F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"),
        F.sum(n * x * y).alias("xy"), F.sum(n * y * y).alias("yy"),
        F.min(F.when(inside, F.col("users_count"))).alias("least"),
        F.max(F.when(inside, F.col("users_count"))).alias("most"),
    ).where(F.col("n") >= min_samples)
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    across = n * F.col("xx") - x * x
    return sums.select(
        *SERIES_KEY, (y / n).alias("mean"), "least", "most",
        (F.sqrt(F.greatest(n * F.col("yy") - y * y, F.lit(0.0))) / n).alias("stddev"),
        F.when(across > 0, (n * F.col("xy") - x * y) / across).otherwise(0.0).alias("slope"))


def counted_profile(counts: DataFrame) -> DataFrame:
    """Mean use per series and hour."""
    return counts.groupBy(*SERIES_KEY, "hour").agg(
        (F.sum(F.col("users_count") * F.col("times")) / F.sum("times")).alias("avg_usage"))


def moving_averages(rows: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Mean of the latest N samples per series (of all, where there are fewer).

    The row_number filter becomes a group limit: a map task passes on at most N samples per series.
    """
    newest = Window.partitionBy(*SERIES_KEY).orderBy(F.col("minute").desc())
    recent = (
        rows.select(*SERIES_KEY, "users_count", minute_index(F.col("date"), F.col("time")).alias("minute"))
        .withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= max(windows))
    )
    means = [F.avg(F.when(F.col("place") <= n, F.col("users_count"))).alias(f"moving_avg_{n}") for n in windows]
    return recent.groupBy(*SERIES_KEY).agg(*means)


def efficiency_score(avg_pct: Column, peak_pct: Column, stddev: Column, total: Column) -> Column:
    """0-100: rewards 30-80 % mean use, takes off for a peak above twice the mean and for wide spread."""
    base = (
        F.when(avg_pct < 30, avg_pct / 30 * 100)
        .when(avg_pct > 80, F.lit(100.0) - (avg_pct - 80) / 20 * 30)
        .otherwise(100.0)
    )
    ratio = F.when(avg_pct > 0, F.try_divide(peak_pct, avg_pct)).otherwise(1.0)
    peak_cost = F.greatest((ratio - 2) * 10, F.lit(0.0))
    spread_cost = F.when(stddev > total * 0.3, 10.0).otherwise(0.0)
    bounded = F.least(F.greatest(base - peak_cost - spread_cost, F.lit(0.0)), F.lit(100.0))
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(bounded)


def enhanced_statistics(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """All statistics of a series side by side; the parts are aggregates joined on the series key. The samples are read
    twice: for the counts and for the latest ones.

    The peak hour covers the cutoff's own day too, the rest starts on the first whole day. The last
    three calendar columns repeat fixed answers of the monitored system.
    """
    start = first_whole_day(as_of, days)
    counts = counted_samples(usage, as_of, days)
    fitted = series_moments(counts, start, MIN_SAMPLES)
    hours = peak_hour(counted_profile(counts))
    total, mean, slope = F.col("total_licenses"), F.col("mean"), F.col("slope")
    avg_pct, peak_pct = F.col("avg_utilization_pct"), F.col("peak_utilization_pct")
    joined = (
        fitted.join(series_capacity(features), SERIES_KEY)
        .join(series_median(counts, start), SERIES_KEY)
        .join(moving_averages(since(usage, start)), SERIES_KEY)
        .join(hours, SERIES_KEY, "left")
        .withColumn("peak_usage", F.greatest("most", F.lit(0)))
        .withColumn("avg_utilization_pct", m.mean_percent_of(mean, total))
        .withColumn("peak_utilization_pct", m.mean_percent_of(F.col("peak_usage").cast("double"), total))
    )
    return joined.select(
        *SERIES_KEY, "total_licenses", mean.alias("avg_usage"), "median_usage", "peak_usage",
        F.col("least").alias("min_usage"), F.col("stddev").alias("std_dev"), "avg_utilization_pct",
        "peak_utilization_pct", m.trend_direction(slope).alias("trend_direction"), slope.alias("trend_slope"),
        m.trend_strength(slope).alias("trend_strength"), F.col("moving_avg_7").alias("moving_avg_7day"),
        F.col("moving_avg_30").alias("moving_avg_30day"), F.coalesce("peak_hour", F.lit(0)).alias("peak_hour"),
        F.lit(0).alias("peak_day_of_week"), mean.alias("weekday_avg"), mean.alias("weekend_avg"),
        efficiency_score(avg_pct, peak_pct, F.col("stddev"), total).alias("efficiency_score"),
        ((F.lit(100.0) - avg_pct) / 10).cast("int").alias("underutilized_hours"),
    )


def unfold_advice(df: DataFrame, kept: list[str], rules: list[tuple[Column, Column]]) -> DataFrame:
    """One row per rule that holds."""
    holding = F.array_compact(F.array(*[F.when(condition, told) for condition, told in rules]))
    return df.select(*kept, F.explode(holding).alias("advice")).select(*kept, "advice.*")


def recommendations(statistics: DataFrame) -> DataFrame:
    """Rule-based advice on the rows of enhanced_statistics; `value` is the number the text quotes."""
    avg_pct, peak_pct = F.col("avg_utilization_pct"), F.col("peak_utilization_pct")
    slope, total = F.col("trend_slope"), F.col("total_licenses")
    rules = [
        (avg_pct > 80, advice("high_average", avg_pct, m.fixed(avg_pct, 1))),
        (peak_pct > 95, advice("high_peak", peak_pct, m.fixed(peak_pct, 1))),
        ((avg_pct < 20) & (total > 5),
         advice("low_average", avg_pct, m.fixed(avg_pct, 1), (total * 0.5).cast("int"))),
        (slope > 0.5, advice("growing", slope, m.fixed(slope, 1))),
        (slope < -0.5, advice("declining", -slope, m.fixed(-slope, 1))),
    ]
    return unfold_advice(statistics, SERIES_KEY, rules)
