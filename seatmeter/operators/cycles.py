"""Daily and weekly cycles of a series, and the hours of the week at which it is busy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.schemas import SERIES_KEY

DAILY, WEEKLY = 24, 168          # lags in hours
CYCLE = 0.3                      # autocorrelation from which on there is a cycle
LEAST_PAIRS = 10                 # hours with a partner one lag later, for a cycle to be seen
BUSY = 1.25                      # of the series' mean: an hour of the week above it is busy


def hourly_series(usage: DataFrame) -> DataFrame:
    """(series, slot, level): mean use in each hour with a sample; slots count hours."""
    hour = F.datediff("date", F.lit("1970-01-01").cast("date")) * 24 + m.sample_hour(F.col("time"))
    return usage.where(F.col("date").isNotNull()).groupBy(*SERIES_KEY, hour.alias("slot")).agg(
        F.avg("users_count").alias("level"))


def _lagged(hours: DataFrame, lag: int) -> DataFrame:
    """Sums over the hours that have a partner `lag` hours later. Each hour is put beside its partner by grouping."""
    name = f"lag{lag}"
    sides = hours.select(*SERIES_KEY, F.inline(F.array(
        F.struct("slot", F.col("level").alias("x"), F.lit(None).cast("double").alias("y")),
        F.struct((F.col("slot") - lag).alias("slot"), F.lit(None).cast("double").alias("x"), F.col("level").alias("y")))))
    pairs = sides.groupBy(*SERIES_KEY, "slot").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*SERIES_KEY).agg(
        F.count("*").alias(f"{name}_pairs"), F.sum(F.col("x") * F.col("y")).alias(f"{name}_xy"),
        F.sum(F.col("x") + F.col("y")).alias(f"{name}_sum"))


def cycles(usage: DataFrame) -> DataFrame:
    """Autocorrelation of the hourly series at a day and at a week, and whether that makes a cycle.

    Hours without a sample have no pairs. Without a pair, or without any variation, the autocorrelation is null; below
    `LEAST_PAIRS` pairs there is no cycle.
    """
    hours = hourly_series(usage)
    totals = hours.groupBy(*SERIES_KEY).agg(
        F.count("*").alias("hours"), F.avg("level").alias("mean"), F.var_pop("level").alias("variance"))
    for lag in (DAILY, WEEKLY):
        totals = totals.join(_lagged(hours, lag), SERIES_KEY, "left")

    def correlation(lag: int) -> Column:
        pairs, mean = F.col(f"lag{lag}_pairs"), F.col("mean")
        covariance = (F.col(f"lag{lag}_xy") - mean * F.col(f"lag{lag}_sum")) / pairs + mean * mean
        return F.when((pairs > 0) & (F.col("variance") > 1e-9), covariance / F.col("variance"))

    def cycle(lag: int, name: str) -> Column:
        seen = (F.col(f"lag{lag}_pairs") >= LEAST_PAIRS) & (F.col(name) >= CYCLE)
        return F.coalesce(seen, F.lit(False))

    out = totals.withColumn("daily", correlation(DAILY)).withColumn("weekly", correlation(WEEKLY))
    return out.select(
        *SERIES_KEY, "hours", F.coalesce(f"lag{DAILY}_pairs", F.lit(0)).alias("daily_pairs"),
        F.coalesce(f"lag{WEEKLY}_pairs", F.lit(0)).alias("weekly_pairs"), F.col("daily").alias("daily_correlation"),
        F.col("weekly").alias("weekly_correlation"), cycle(DAILY, "daily").alias("has_daily_cycle"),
        cycle(WEEKLY, "weekly").alias("has_weekly_cycle"))


def seasonal_patterns(usage: DataFrame) -> DataFrame:
    """`cycles` with the mean by hour of the day (24 values) and by weekday (7, Sunday first); null: no sample."""
    hour, day = m.sample_hour(F.col("time")), F.dayofweek("date") - 1

    def pattern(slot: Column, size: int, name: str) -> DataFrame:
        means = usage.groupBy(*SERIES_KEY, slot.alias("slot")).agg(F.avg("users_count").alias("level"))
        found = F.map_from_entries(F.collect_list(F.struct("slot", "level")))
        values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(F.col("found"), i))
        return means.where("slot IS NOT NULL").groupBy(*SERIES_KEY).agg(found.alias("found")).select(
            *SERIES_KEY, values.alias(name))

    return (cycles(usage).join(pattern(hour, 24, "hourly_pattern"), SERIES_KEY, "left")
            .join(pattern(day, 7, "daily_pattern"), SERIES_KEY, "left"))


def _label(start: Column, hours: Column) -> Column:
    middle = F.pmod(start + F.floor(hours / 2), F.lit(24))
    return (F.when((hours >= 6) & (hours <= 14) & start.between(6, 10), "Business Hours")
            .when(middle.between(5, 11), "Morning Peak").when(middle.between(12, 16), "Afternoon Peak")
            .when(middle.between(17, 21), "Evening Peak").otherwise("Night Peak"))


def peak_periods(usage: DataFrame) -> DataFrame:
    """Stretches of busy hours: start_hour, hours, end_hour (the last busy one), the weekdays they start on (0: Sunday),
    mean use and a label.

    The week is a circle of 168 hours, so a stretch may run over midnight and over the end of the week. A series' week
    is one array of that length; stretches with equal start hour and length are one period of several days. An hour is
    busy from `BUSY` times the mean of the series' hours of the week on; hours without a sample are not. A series whose
    hours are all busy does not exist, as their mean is one of them.
    """
    slot = ((F.dayofweek("date") - 1) * 24 + m.sample_hour(F.col("time"))).alias("slot")
    cells = usage.groupBy(*SERIES_KEY, slot).agg(F.avg("users_count").alias("level")).where("slot IS NOT NULL")
    found = F.map_from_entries(F.collect_list(F.struct("slot", "level")))
    week = cells.groupBy(*SERIES_KEY).agg(F.avg("level").alias("mean"), found.alias("found")).withColumn(
        "level", F.transform(F.sequence(F.lit(0), F.lit(167)), lambda i: F.try_element_at(F.col("found"), i)))
    week = week.where("mean > 0").withColumn("busy", F.transform("level", lambda x: F.coalesce(
        x >= F.col("mean") * BUSY - 1e-9, F.lit(False))))
    twice = week.withColumn("busy", F.concat("busy", "busy")).withColumn("level", F.concat("level", "level"))
    starts = F.filter(F.sequence(F.lit(0), F.lit(167)),
                      lambda i: F.get("busy", i) & ~F.get("busy", i + 167))
    stretches = twice.select(*SERIES_KEY, "busy", "level", F.explode(starts).alias("start"))
    hours = F.array_position(F.slice("busy", F.col("start") + 1, F.lit(168)), False) - 1
    stretches = stretches.withColumn("hours", hours.cast("int"))
    total = F.aggregate(F.slice("level", F.col("start") + 1, F.col("hours")), F.lit(0.0), lambda a, x: a + x)
    stretches = stretches.select(*SERIES_KEY, F.col("start").alias("at"), F.pmod("start", F.lit(24)).alias("start_hour"),
                                 "hours", total.alias("total"))
    periods = stretches.groupBy(*SERIES_KEY, "start_hour", "hours").agg(
        F.array_sort(F.collect_set(F.floor(F.col("at") / 24).cast("int"))).alias("days_of_week"),
        (F.sum("total") / F.sum("hours")).alias("avg_usage"))
    return periods.select(
        *SERIES_KEY, "start_hour", "hours", F.pmod(F.col("start_hour") + F.col("hours") - 1, F.lit(24)).alias("end_hour"),
        "days_of_week", "avg_usage", _label(F.col("start_hour"), F.col("hours")).alias("label"))
