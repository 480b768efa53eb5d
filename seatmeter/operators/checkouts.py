"""Who holds which license: counts per pool, detail with age, and feature listings with counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m


def checkout_counts(features: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Checkouts per pool, matched on server, feature and license version; 0 where there are none.

    Pools that differ only in expiry all show the full count. Counting before the join leaves one row
    per (server, feature, version).
    """
    key = ["server_hostname", "name", "version"]
    counted = checkouts.groupBy(
        "server_hostname", F.col("feature_name").alias("name"), F.col("license_version").alias("version")
    ).agg(F.count(F.lit(1)).alias("checkout_count"))
    return (
        features.join(counted, key, "left")
        .withColumn("checkout_count", F.coalesce("checkout_count", F.lit(0)))
        .withColumn("available_licenses", m.available_clamped(F.col("total_licenses"), F.col("used_licenses")))
    )


def checked_out_only(features: DataFrame, checkouts: DataFrame) -> DataFrame:
    return checkout_counts(features, checkouts).where(F.col("checkout_count") > 0)


def counts_by_name(checkouts: DataFrame) -> DataFrame:
    """Checkouts per feature, over all license versions."""
    return checkouts.groupBy("server_hostname", "feature_name").agg(F.count(F.lit(1)).alias("checkout_count"))


def checkout_detail(checkouts: DataFrame, as_of: datetime, server: str | None = None,
                    feature: str | None = None) -> DataFrame:
    """One row per checkout with its age; the feature is matched without regard to case."""
    rows = checkouts.where(F.col("feature_name").isNotNull())
    if server:
        rows = rows.where(F.col("server_hostname") == server)
    if feature:
        rows = rows.where(F.lower("feature_name") == feature.lower())
    since, now = F.col("checked_out_at"), m.moment(as_of)
    return rows.select(
        "server_hostname", "feature_name", "license_version",
        F.coalesce("username", F.lit("-")).alias("username"), F.coalesce("host", F.lit("-")).alias("host"),
        "version", "checked_out_at",
        F.coalesce(m.age_long(since, now), F.lit("-")).alias("age"),
        F.coalesce(m.age_short(since, now), F.lit("-")).alias("duration"),
    )


def pool_checkouts(features: DataFrame, checkouts: DataFrame, as_of: datetime) -> DataFrame:
    """The checkouts below each pool, one row each (pools without any are absent)."""
    detail = checkout_detail(checkouts, as_of).withColumnRenamed("version", "client_version")
    pools = features.select(
        "id", "server_hostname", F.col("name").alias("feature_name"), F.col("version").alias("license_version"),
        "expiration_date", "total_licenses",
    )
    return pools.join(detail, ["server_hostname", "feature_name", "license_version"])
