"""Server status, license pools and checkouts from RLM status texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.functions.dates import expiry_timestamp, rlm_start
from seatmeter.operators.dump_lines import (
    CHECKOUT_COLUMNS, FEATURE_COLUMNS, STATUS_COLUMNS, carried, count_at, first_kind, group, numbered_lines,
    stripped, with_computed,
)

# Line patterns, names that are tools and not features, the count of an uncounted license.
STATUS = r"rlm status on\s+([^\s]+)"
SOFTWARE = r"rlm software version v([\d\.]+)"
VENDOR = r"^(\w+)\s+\d+\s+(\w+)\s+\d+"
HEADER = r"(?i)^([\w\+]+)\s+(\w[\d\.]+).*pool.*$"
COUNT = r"^count:\s+(\d+)[,\s]+.*inuse:\s+(\d+)[,\s]+.*exp:\s+(\d+-\w+-\d{4}|\w+)"
UNCOUNTED = r"^UNCOUNTED[,\s]+.*inuse:\s+(\d+)(?:[,\s]+.*exp:\s+(\d+-\w+-\d{4}|\w+))?"
CHECKOUT = r"^([\w\+]+)\s+(v[\d\.]+):\s+([\w\.\-]+@[\w\-]+)\s+\d+\/\d+\s+at\s+(\d+\/\d+\s+\d+:\d+)"
EXCLUDED = ["rlm", "rlmutil", "rlmstat", "rlmdown", "rlmreread"]
UNCOUNTED_LICENSES = 999


def _classified(dumps: DataFrame) -> DataFrame:
    line = F.col("line")
    tests = [
        ("status", line.rlike(STATUS)), ("software", line.rlike(SOFTWARE)), ("vendor", line.rlike(VENDOR)),
        ("header", line.rlike(HEADER)), ("count", line.rlike(COUNT)), ("uncounted", line.rlike(UNCOUNTED)),
        ("checkout", line.rlike(CHECKOUT)),
    ]
    lines = numbered_lines(dumps).withColumn("line", stripped(F.col("line")))
    return with_computed(lines, kind=first_kind(tests))


def read_lines(dumps: DataFrame) -> DataFrame:
    """The lines of interest, and the first one of each text. Settled, they serve status, pools and checkouts."""
    return _classified(dumps).where(F.col("kind").isNotNull() | (F.col("line_no") == 0))


def rlm_status(dumps: DataFrame) -> DataFrame:
    return status_of(_classified(dumps))


def status_of(lines: DataFrame) -> DataFrame:
    """One row per text: the last of "status on" and "vendor not running" decides the service state."""
    line, kind, at = F.col("line"), F.col("kind"), F.col("line_no")
    vendor_down = (kind == "vendor") & (group(line, VENDOR, 2) != "Yes")
    state = F.when(kind == "status", "up").when(vendor_down, "warning")
    # Each pattern is run on the lines of its kind only.
    seen = lines.select(
        "dump_id", "host", "captured_at", "line_no", state.alias("state"),
        F.when(kind == "status", group(line, STATUS, 1)).alias("master"),
        F.when(kind == "software", group(line, SOFTWARE, 1)).alias("version"),
        F.when(vendor_down, group(line, VENDOR, 1)).alias("down_vendor"),
    ).groupBy("dump_id", "host", "captured_at").agg(*[
        F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(into) for name, into in
        [("state", "service"), ("master", "master"), ("version", "version"), ("down_vendor", "down_vendor")]])
    message = F.concat(F.lit("ISV "), "down_vendor", F.lit(" appears to be down on "), "host")
    return seen.select(
        "dump_id", F.col("host").alias("hostname"), F.coalesce("service", F.lit("down")).alias("service"),
        F.coalesce("master", F.lit("")).alias("master"), F.coalesce("version", F.lit("")).alias("version"),
        F.coalesce(message, F.lit("")).alias("message"), F.col("captured_at").alias("last_checked"),
    ).select(*STATUS_COLUMNS)


def rlm_features(dumps: DataFrame) -> DataFrame:
    return features_of(_classified(dumps))


def features_of(lines: DataFrame) -> DataFrame:
    """One pool per feature name and text: the last count line below a header of that name."""
    line, kind = F.col("line"), F.col("kind")
    header_name = group(line, HEADER, 1)
    is_tool = header_name.isin(EXCLUDED)
    context = (
        lines.where(kind.isin("vendor", "header", "count", "uncounted"))
        .withColumn("current", carried(F.when(kind == "header", F.when(is_tool, "").otherwise(header_name))))
        .withColumn("version", carried(F.when(kind == "header", F.when(is_tool, "").otherwise(
            group(line, HEADER, 2)))))
        .withColumn("vendor_daemon", carried(F.when(kind == "vendor", group(line, VENDOR, 1))))
    )
    counted = kind == "count"
    pools = context.where(kind.isin("count", "uncounted") & (F.col("current") != "")).select(
        "dump_id", "host", "captured_at", "current", "line_no",
        F.struct(
            "version", F.coalesce("vendor_daemon", F.lit("")).alias("vendor_daemon"),
            F.when(counted, count_at(line, COUNT, 1)).otherwise(UNCOUNTED_LICENSES).alias("total"),
            F.when(counted, count_at(line, COUNT, 2)).otherwise(count_at(line, UNCOUNTED, 1)).alias("used"),
            F.when(counted, group(line, COUNT, 3)).otherwise(group(line, UNCOUNTED, 2)).alias("expiry_text"),
        ).alias("pool"),
    )
    last = pools.groupBy("dump_id", "host", "captured_at", "current").agg(F.max_by("pool", "line_no").alias("pool"))
    return last.select(
        "dump_id", F.col("host").alias("server_hostname"), F.col("current").alias("name"), "pool.version",
        "pool.vendor_daemon", F.col("pool.total").alias("total_licenses"), F.col("pool.used").alias("used_licenses"),
        expiry_timestamp(F.col("pool.expiry_text")).alias("expiration_date"),
        F.col("captured_at").alias("last_updated"),
    ).select(*FEATURE_COLUMNS)


def rlm_checkouts(dumps: DataFrame) -> DataFrame:
    return checkouts_of(_classified(dumps))


def checkouts_of(lines: DataFrame) -> DataFrame:
    """One row per checkout line; each line stands for itself, so stored texts are not shuffled at all."""
    line = F.col("line")
    holder = group(line, CHECKOUT, 3)
    return (
        lines.where(F.col("kind") == "checkout")
        .select(
            "dump_id", F.col("host").alias("server_hostname"), group(line, CHECKOUT, 1).alias("feature_name"),
            F.substring_index(holder, "@", 1).alias("username"), F.substring_index(holder, "@", -1).alias("host"),
            rlm_start(group(line, CHECKOUT, 4), F.col("captured_at")).alias("checked_out_at"),
            group(line, CHECKOUT, 2).alias("version"), group(line, CHECKOUT, 2).alias("license_version"),
        )
        .where(F.col("checked_out_at").isNotNull()).select(*CHECKOUT_COLUMNS)
    )
