"""Texts of recommendations and actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type, priority, title, description and impact of each recommendation; {} stands for a number.
ADVICE = {
    "high_average": (
        "increase", "high", "High Utilization Alert",
        "Average utilization is {}%, which is above the recommended 80% threshold.",
        "Users may experience license denials during peak times"),
    "high_peak": (
        "alert", "high", "Peak Capacity Reached",
        "Peak utilization reached {}%, indicating license shortage during peak times.",
        "Immediate risk of license denials"),
    "low_average": (
        "reduce", "medium", "License Optimization Opportunity",
        "Average utilization is only {}%. Consider reducing license count to optimize costs.",
        "Potential to reduce licenses by {} without impacting users"),
    "growing": (
        "increase", "medium", "Growing Demand Detected",
        "Usage is increasing by approximately {} licenses per day.",
        "Plan for additional licenses within the next quarter"),
    "declining": (
        "reduce", "low", "Declining Usage Trend",
        "Usage is decreasing by approximately {} licenses per day.",
        "Opportunity to reduce licenses during next renewal"),
    "many_at_capacity": (
        "increase", "high", "Features at High Utilization",
        "{} features have utilization above 80% and may need additional licenses.",
        "Prevent license denials and ensure user productivity"),
    "many_underused": (
        "reduce", "medium", "Underutilized Features Detected",
        "{} features have utilization below 20% and may have excess licenses.",
        "Potential cost savings by reducing unused licenses"),
    "many_growing": (
        "alert", "medium", "Growing Usage Trends",
        "{} features show increasing usage trends.",
        "Plan for capacity increases in the next quarter"),
    "large_usage": (
        "retention", "medium", "Large Usage History",
        "feature_usage table has {} rows. Consider implementing data retention.",
        "Reducing old data can significantly reduce database size"),
    "many_inactive": (
        "cleanup", "low", "Inactive Features",
        "There are {} inactive feature records that could be archived.",
        "Minor space savings, cleaner data"),
}
# The actions that go with storage advice, capacity trends and capacity classes.
STORAGE_ACTIONS = {
    "retention": "Configure data retention policy to delete data older than 90-365 days",
    "cleanup": "Archive or delete old inactive feature records",
}
TREND_ACTIONS = {
    "full": "Immediately increase license count - at capacity",
    "near": "Consider increasing license count within 30 days",
    "ahead": "Monitor usage and plan for potential license increase",
    "shrinking": "Consider reducing license count to optimize costs",
    "none": "No action required",
}
CAPACITY_CLASSES = {
    "high_utilization": "High utilization - consider increasing licenses",
    "low_utilization": "Low utilization - consider reducing licenses",
    "trending_up": "Usage increasing - monitor capacity",
    "trending_down": "Usage decreasing - opportunity to optimize",
}


def _filled(text: str, number: Column | None) -> Column:
    if number is None or "{}" not in text:
        return F.lit(text)
    before, after = text.split("{}")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def advice(name: str, value: Column, shown: Column | None = None, impact_number: Column | None = None) -> Column:
    """A recommendation as a struct; `value` is the number behind it, `shown` the way its text writes it."""
    kind, priority, title, description, impact = ADVICE[name]
    return F.struct(
        F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(title).alias("title"),
        value.cast("double").alias("value"),
        _filled(description, value if shown is None else shown).alias("description"),
        _filled(impact, impact_number).alias("impact"),
    )
