"""Expiry alerts: candidates, throttle, queue listings, delivery state, rendered messages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.operators.inventory import expiring_features
from seatmeter.schemas import TABLES

ALERT_COLUMNS = [column.split()[0] for column in TABLES["alerts"].split(", ")]
EXPIRATION = "expiration"


def throttled_hosts(alert_events: DataFrame, as_of: datetime, interval_minutes: int) -> DataFrame:
    """(hostname, type) pairs that got an alert within the resend interval."""
    cutoff = as_of - timedelta(minutes=interval_minutes)
    return alert_events.where(F.col("datetime") > m.moment(cutoff)).select("hostname", "type").distinct()


def expiry_alerts(features: DataFrame, alert_events: DataFrame, as_of: datetime, lead_days: int = 10,
                  interval_minutes: int = 60) -> DataFrame:
    """Alerts one expiry check creates.

    The throttle counts per host and type, and the check records each alert before it looks at the next
    feature: with an interval, only the first expiring feature of a free host gets an alert.
    """
    candidates = expiring_features(features, as_of, lead_days).select(
        "id", "server_hostname", "name", "version", "expiration_date", "severity", "message"
    )
    if interval_minutes > 0:
        row = F.struct("expiration_date", "name", "version", "id", "severity", "message")
        candidates = candidates.groupBy("server_hostname").agg(F.min(row).alias("first")).select(
            "server_hostname", "first.*"
        )
    busy = throttled_hosts(alert_events, as_of, interval_minutes).where(F.col("type") == EXPIRATION)
    free = candidates.join(
        busy.select(F.col("hostname").alias("server_hostname")), "server_hostname", "left_anti"
    )
    return free.select(
        "id", "server_hostname", F.col("name").alias("feature_name"), F.lit(EXPIRATION).alias("alert_type"),
        "message", "severity", F.lit(False).alias("sent"), F.lit(None).cast("timestamp").alias("sent_at"),
        m.moment(as_of).alias("created_at"),
    )


def throttle_events(alerts: DataFrame) -> DataFrame:
    """The throttle entries that go with new alerts."""
    return alerts.select("id", F.col("created_at").alias("datetime"), F.col("alert_type").alias("type"),
                         F.col("server_hostname").alias("hostname"))


def append_alerts(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """Queue with `new` added as not yet sent, under ids above all stored ones (unique, with gaps)."""
    last_id = alerts.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    waiting = (
        new.withColumn("id", F.monotonically_increasing_id() + last_id + 1)
        .withColumn("sent", F.lit(False)).withColumn("sent_at", F.lit(None).cast("timestamp"))
    )
    return alerts.select(*ALERT_COLUMNS).unionByName(waiting.select(*ALERT_COLUMNS))


def unsent_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(~F.col("sent")).orderBy("created_at", "id")


def top_unsent(alerts: DataFrame, count: int = 5) -> DataFrame:
    return unsent_alerts(alerts).limit(count)


def recent_alerts(alerts: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    cutoff = m.moment(as_of - timedelta(days=days))
    return (
        alerts.where(F.col("created_at") > cutoff)
        .withColumn("delivery_status", m.delivery_status(F.col("sent")))
        .orderBy(F.col("created_at").desc(), "id")
    )


def mark_sent(alerts: DataFrame, delivered: DataFrame, as_of: datetime) -> DataFrame:
    """Alerts whose id is in `delivered` become sent as of now."""
    done = delivered.select("id").distinct().withColumn("delivered", F.lit(True))
    return (
        alerts.join(done, "id", "left")
        .withColumn("sent", F.coalesce("delivered", "sent"))
        .withColumn("sent_at", F.when(F.col("delivered"), m.moment(as_of)).otherwise(F.col("sent_at")))
        .select(*ALERT_COLUMNS)
    )


def alert_messages(alerts: DataFrame, to: list[str], critical_to: list[str]) -> DataFrame:
    """Unsent alerts rendered for delivery; critical ones also go to the second list."""
    everyone = F.array(*[F.lit(a) for a in to])
    more = F.array(*[F.lit(a) for a in [*to, *critical_to]])

    def line(label: str, value):
        return F.concat(F.lit(f"{label}: "), value)

    # Fixed value: the layout of a delivered message.
    body = F.concat_ws(
        "\n", F.lit("License Alert"), F.lit(""),
        line("Server", F.col("server_hostname")), line("Feature", F.col("feature_name")),
        line("Type", F.col("alert_type")), line("Severity", F.col("severity")),
        line("Time", m.rfc3339(F.col("created_at"))), F.lit(""),
        F.lit("Message:"), F.col("message"),
    )
    return unsent_alerts(alerts).select(
        "id", F.when(F.col("severity") == "critical", more).otherwise(everyone).alias("recipients"),
        F.concat(F.lit("["), "severity", F.lit("] License Alert: "), "alert_type").alias("subject"),
        body.alias("body"),
    )
