"""Column expressions for counts, percentages, bands and texts. All stay in whole-stage codegen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def moment(value: datetime) -> Column:
    """A literal read in the session time zone, whatever zone the driver process runs in."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def fixed(value: Column, places: int) -> Column:
    """Number as text with fixed decimals, exact ties to the even digit."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def available(total: Column, used: Column) -> Column:
    """Free licenses; negative when a pool is overdrawn."""
    return total - used


def available_clamped(total: Column, used: Column) -> Column:
    return F.greatest(total - used, F.lit(0))


def percent_of(part: Column, total: Column) -> Column:
    """part / total in percent, 0.0 when there is no total."""
    return F.when(total > 0, part * 100.0 / total).otherwise(F.lit(0.0))


def mean_percent_of(mean: Column, total: Column) -> Column:
    """As percent_of, for a mean: divides first, as the stored statistics do."""
    return F.when(total > 0, mean / total * 100.0).otherwise(F.lit(0.0))


def sample_timestamp(date: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat_ws(" ", date.cast("string"), time), "yyyy-MM-dd HH:mm:ss")


def sample_hour(time: Column) -> Column:
    return F.substring(time, 1, 2).cast("int")


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:00")


def days_until(moment: Column, as_of: Column) -> Column:
    """Whole days from as_of to moment, truncated toward zero; negative when past."""
    seconds = F.unix_micros(moment) - F.unix_micros(as_of)
    return (seconds / F.lit(SECONDS_PER_DAY * 1_000_000)).cast("int")


def expiry_label(is_active: Column, days: Column) -> Column:
    return (
        F.when(~is_active, "Inactive")
        .when(days < 0, "Expired")
        .when(days < 30, "Expiring Soon")
        .otherwise("Valid")
    )


def utilization_band(pct: Column) -> Column:
    return F.when(pct >= 90, "high").when(pct >= 70, "medium").otherwise("low")


def trend_direction(slope: Column) -> Column:
    return F.when(slope > 0.1, "increasing").when(slope < -0.1, "decreasing").otherwise("stable")


def trend_strength(slope: Column) -> Column:
    size = F.abs(slope)
    return F.when(size > 1.0, "strong").when(size > 0.3, "moderate").otherwise("weak")


def alert_severity(days: Column) -> Column:
    return F.when(days <= 3, "critical").when(days <= 7, "warning").otherwise("info")


def alert_message(feature: Column, server: Column, days: Column, expires: Column) -> Column:
    # Fixed value: the wording of an expiry alert.
    return F.concat(
        F.lit("License '"), feature, F.lit("' on "), server, F.lit(" expires in "),
        days.cast("string"), F.lit(" days ("), F.date_format(expires, "yyyy-MM-dd"), F.lit(")"),
    )


def delivery_status(sent: Column) -> Column:
    return F.when(sent, "Sent").otherwise("Pending")


def capacity_warning(days_to_capacity: Column) -> Column:
    return (days_to_capacity > 0) & (days_to_capacity < 90)


def anomaly_severity(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size > 3.0, "high").when(size > 2.5, "medium").otherwise("low")


def days_to_capacity(slope: Column, total: Column, expected_now: Column) -> Column:
    """Whole days until a rising line reaches the total; -1 when it never does or already has."""
    remaining = total - expected_now
    reachable = (slope > 0) & (total > 0) & (remaining > 0)
    # A nearly flat line may lie further away than an int reaches.
    days = F.least(F.try_divide(remaining, slope), F.lit(2_147_483_647.0))
    return F.when(reachable, days.cast("int")).otherwise(-1)


def _elapsed_seconds(since: Column, as_of: Column) -> Column:
    return F.floor((F.unix_micros(as_of) - F.unix_micros(since)) / F.lit(1_000_000))


def _number(value: Column, unit: str) -> Column:
    return F.concat(value.cast("long").cast("string"), F.lit(unit))


def age_long(since: Column, as_of: Column) -> Column:
    """Age as `Xd Yh Zm`, `Yh Zm` or `Zm`."""
    seconds = _elapsed_seconds(since, as_of)
    days = F.floor(seconds / SECONDS_PER_DAY)
    hours = F.floor(seconds / 3600) % 24
    minutes = F.floor(seconds / 60) % 60
    return (
        F.when(days > 0, F.concat_ws(" ", _number(days, "d"), _number(hours, "h"), _number(minutes, "m")))
        .when(hours > 0, F.concat_ws(" ", _number(hours, "h"), _number(minutes, "m")))
        .otherwise(_number(minutes, "m"))
    )


def age_short(since: Column, as_of: Column) -> Column:
    """Age in its two largest units: `Xd Yh`, `Xh Ym`, `Xm` or `Xs`."""
    seconds = _elapsed_seconds(since, as_of)
    minutes = F.floor(seconds / 60)
    hours = F.floor(seconds / 3600)
    days = F.floor(seconds / SECONDS_PER_DAY)
    return (
        F.when(days > 0, F.concat_ws(" ", _number(days, "d"), _number(hours % 24, "h")))
        .when(hours > 0, F.concat_ws(" ", _number(hours, "h"), _number(minutes % 60, "m")))
        .when(minutes > 0, _number(minutes, "m"))
        .otherwise(_number(seconds, "s"))
    )


def bytes_text(size: Column) -> Column:
    """Size with one decimal in the largest 1024-based unit that keeps it at 1 or more."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB", "PB", "EB"], start=1):
        step = 1024 ** power
        scaled = F.concat(fixed(size / F.lit(float(step)), 1), F.lit(" " + unit))
        text = F.when(size >= F.lit(step), scaled).otherwise(text)
    return text


def file_name_part(text: Column) -> Column:
    """Text reduced to letters, digits, `_` and `-` for use in a path; empty becomes `export`."""
    joined = F.regexp_replace(text, r"[@:/\\ ]", "_")
    kept = F.regexp_replace(joined, r"[^A-Za-z0-9_-]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("export"))
