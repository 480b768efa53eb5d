"""The license-pool inventory: refresh, duplicates, current state, and the plain listings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.operators.keys import earliest_per_key, latest_per_key
from seatmeter.schemas import POOL_KEY, TABLES

FEATURE_COLUMNS = [column.split()[0] for column in TABLES["features"].split(", ")]


def latest_pools(polls: DataFrame) -> DataFrame:
    """The last poll of every pool in an append-only poll log, without telling which are still listed."""
    pools = latest_per_key(
        polls.select(*POOL_KEY, "poll_id", "vendor_daemon", "total_licenses", "used_licenses", "polled_at"),
        POOL_KEY, "poll_id", ["total_licenses", "used_licenses", "polled_at"], ["vendor_daemon"],
    )
    return pools.select(
        F.col("poll_id").alias("id"), *POOL_KEY[:3], "vendor_daemon", "total_licenses", "used_licenses",
        "expiration_date", F.col("polled_at").alias("last_updated"),
    )


def inventory_from_polls(polls: DataFrame) -> DataFrame:
    """Inventory as left behind by a poll log: a pool is active when its server's latest poll listed it.

    The second branch reads two columns of the log and shrinks to one row per server.
    """
    latest = polls.groupBy("server_hostname").agg(F.max("polled_at").alias("latest_poll"))
    return latest_pools(polls).join(latest, "server_hostname").select(
        *[c for c in FEATURE_COLUMNS if c != "is_active"],
        (F.col("last_updated") == F.col("latest_poll")).alias("is_active"),
    )


def refresh_inventory(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Inventory after new poll results: pools of the polled servers become inactive unless listed again.

    Servers without rows in `batch` are left alone, so a poll that returned nothing changes nothing. Where
    the batch holds several polls of a server, its latest one decides what is active. Polls count by their time, not by
    their arrival: one that is older than what is known of its server adds pools and replaces older numbers, but it
    neither replaces newer ones nor decides what is active. Of equal times the later arrival counts.
    """
    known = current.select(*FEATURE_COLUMNS, F.lit(0).alias("round"))
    listed = batch.select(*FEATURE_COLUMNS, F.lit(1).alias("round"))
    ordered = known.unionByName(listed).withColumn("arrival", F.struct("last_updated", "round", "id"))
    merged = latest_per_key(
        ordered, POOL_KEY, "arrival",
        ["id", "total_licenses", "used_licenses", "last_updated", "is_active"], ["vendor_daemon"],
    )
    latest = ordered.groupBy("server_hostname").agg(
        F.max(F.when(F.col("round") == 0, F.col("last_updated"))).alias("latest_known"),
        F.max(F.when(F.col("round") == 1, F.col("last_updated"))).alias("latest_poll"))
    is_new = F.col("arrival.round") == 1
    newer = F.col("latest_known").isNull() | (F.col("latest_poll") >= F.col("latest_known"))
    active = (F.when(F.col("latest_poll").isNull(), F.col("is_active"))
              .when(newer, is_new & (F.col("last_updated") == F.col("latest_poll")))
              .otherwise(~is_new & F.col("is_active")))
    return merged.join(latest, "server_hostname", "left").withColumn("is_active", active).select(*FEATURE_COLUMNS)


def drop_duplicate_features(features: DataFrame) -> DataFrame:
    """Keep the largest id per (server, name, version) among pools with an expiry; others stay."""
    key = ["server_hostname", "name", "version"]
    rest = [c for c in FEATURE_COLUMNS if c not in [*key, "id", "vendor_daemon"]]
    dated = latest_per_key(features.where(F.col("expiration_date").isNotNull()), key, "id", rest, ["vendor_daemon"])
    undated = features.where(F.col("expiration_date").isNull())
    return dated.select(*FEATURE_COLUMNS).unionByName(undated.select(*FEATURE_COLUMNS))


def with_active_flag(features: DataFrame) -> DataFrame:
    """Old inventory rows, written before the flag existed, count as active."""
    if "is_active" not in features.columns:
        return features.withColumn("is_active", F.lit(True))
    return features.withColumn("is_active", F.coalesce("is_active", F.lit(True)))


def current_utilization(features: DataFrame, server: str | None = None) -> DataFrame:
    """`utilization_now`, most used first."""
    return utilization_now(features, server).orderBy(
        F.col("utilization_pct").desc(), "feature_name", "server_hostname", "version")


def utilization_now(features: DataFrame, server: str | None = None) -> DataFrame:
    """Use of every pool with licenses, as of the latest refresh of its (server, feature), in no order; ties stay.

    `rank() = 1` is answered by a group limit before the shuffle: only rows that tie for the latest
    refresh leave a map task, however hot the feature.
    """
    pools = features.where(F.col("total_licenses") > 0)
    if server:
        pools = pools.where(F.col("server_hostname") == server)
    newest = Window.partitionBy("server_hostname", "name").orderBy(F.col("last_updated").desc())
    total, used = F.col("total_licenses"), F.col("used_licenses")
    return (
        pools.withColumn("age_rank", F.rank().over(newest))
        .where(F.col("age_rank") == 1)
        .select(
            "server_hostname", F.col("name").alias("feature_name"), "version", "total_licenses", "used_licenses",
            m.available(total, used).alias("available_licenses"),
            m.percent_of(used, total).alias("utilization_pct"), "vendor_daemon",
        )
    )


def series_capacity(features: DataFrame) -> DataFrame:
    """One license total per (server, feature): that of the pool with the smallest id."""
    return features.groupBy("server_hostname", F.col("name").alias("feature_name")).agg(
        F.min_by("total_licenses", "id").alias("total_licenses")
    )


def features_of(features: DataFrame, server: str | None = None, active_only: bool = True) -> DataFrame:
    rows = features.where(F.col("server_hostname") == server) if server else features
    if active_only:
        rows = rows.where("is_active")
    clamped = m.available_clamped(F.col("total_licenses"), F.col("used_licenses"))
    return rows.withColumn("available_licenses", clamped).orderBy("name", "server_hostname", "id")


def expiring_features(features: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Active pools that expire after as_of and at most `days` later, with days left and severity."""
    expires = F.col("expiration_date")
    left = m.days_until(expires, m.moment(as_of))
    return (
        features.where(
            F.col("is_active") & (expires > m.moment(as_of)) & (expires <= m.moment(as_of + timedelta(days=days)))
        )
        .withColumn("days_to_expire", left)
        .withColumn("severity", m.alert_severity(F.col("days_to_expire")))
        .withColumn("message", m.alert_message(
            F.col("name"), F.col("server_hostname"), F.col("days_to_expire"), expires))
        .orderBy("expiration_date", "name", "server_hostname", "id")
    )


def latest_pool_versions(features: DataFrame) -> DataFrame:
    """Largest id per pool key among pools with an expiry, active or not."""
    rest = [c for c in FEATURE_COLUMNS if c not in [*POOL_KEY, "id", "vendor_daemon"]]
    dated = features.where(F.col("expiration_date").isNotNull())
    return latest_per_key(dated, POOL_KEY, "id", rest, ["vendor_daemon"]).select(*FEATURE_COLUMNS)


def expiration_report(features: DataFrame, as_of: datetime, server: str | None = None,
                      include_inactive: bool = False) -> DataFrame:
    """Pools with an expiry, days left and status label; optionally also those no longer listed."""
    rows = features.where(F.col("server_hostname") == server) if server else features
    if include_inactive:
        rows = latest_pool_versions(rows)
    else:
        rows = rows.where(F.col("expiration_date").isNotNull() & F.col("is_active"))
    days = m.days_until(F.col("expiration_date"), m.moment(as_of))
    return (
        rows.withColumn("days_to_expiration", days)
        .withColumn("status", m.expiry_label(F.col("is_active"), F.col("days_to_expiration")))
        .orderBy(F.col("is_active").desc(), "expiration_date", "name", "server_hostname", "id")
    )


def first_seen_samples(samples: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """Insert-or-ignore on `key`: the first arrival stays."""
    return earliest_per_key(samples, key, order, values, [])
