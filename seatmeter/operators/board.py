"""Small summary tables: tiles, totals, type distribution, server status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m

UNREACHABLE = "No status received"


def overview_tiles(utilization: DataFrame) -> DataFrame:
    return utilization.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.coalesce(F.avg("utilization_pct"), F.lit(0.0)).alias("avg_utilization_pct"),
        F.count_if(F.col("utilization_pct") >= 90).alias("high_utilization"),
        F.coalesce(F.sum("total_licenses"), F.lit(0)).alias("total_licenses"),
    )


def utilization_bands(utilization: DataFrame) -> DataFrame:
    return utilization.withColumn("band", m.utilization_band(F.col("utilization_pct")))


def dashboard_totals(servers: DataFrame, features: DataFrame, alerts: DataFrame) -> DataFrame:
    """Servers, active features, their licenses and open alerts in one row, by uncorrelated subqueries."""
    rows = F.count(F.lit(1))
    pools = features.where("is_active").agg(
        F.struct(rows.alias("n"), F.coalesce(F.sum("total_licenses"), F.lit(0)).alias("licenses")).alias("pools"))
    gathered = servers.sparkSession.range(1).select(
        servers.agg(rows.alias("n")).scalar().alias("total_servers"), pools.scalar().alias("pools"),
        alerts.where(~F.col("sent")).agg(rows.alias("n")).scalar().alias("active_alerts"),
    )
    return gathered.select(
        "total_servers", F.col("pools.n").alias("total_features"), F.col("pools.licenses").alias("total_licenses"),
        "active_alerts",
    )


def server_type_distribution(servers: DataFrame) -> DataFrame:
    """Servers per type with their share, most common first."""
    total = servers.agg(F.count(F.lit(1)).alias("total")).scalar()
    counted = servers.groupBy(F.col("type").alias("server_type")).agg(F.count(F.lit(1)).alias("servers"))
    return (
        counted.withColumn("percentage", m.percent_of(F.col("servers"), total))
        .orderBy(F.col("servers").desc(), "server_type")
    )


def with_server_type(rows: DataFrame, servers: DataFrame, host: str = "server_hostname") -> DataFrame:
    """Rows with the type of their server; servers without a configured type count as flexlm."""
    types = servers.select(F.col("hostname").alias(host), F.col("type").alias("server_type"))
    return rows.join(types, host, "left").withColumn("server_type", F.coalesce("server_type", F.lit("flexlm")))


def status_board(servers: DataFrame, status: DataFrame) -> DataFrame:
    """Every configured server with its status; without one it is down."""
    known = status.select("hostname", "service", "master", F.col("version").alias("server_version"), "message",
                          "last_checked")
    return servers.join(known, "hostname", "left").select(
        "hostname", "description", F.col("type").alias("server_type"),
        F.coalesce("service", F.lit("down")).alias("service"), "master",
        F.coalesce("server_version", F.lit("")).alias("server_version"),
        F.when(F.col("service").isNull(), UNREACHABLE).otherwise(F.coalesce("message", F.lit(""))).alias("message"),
        "last_checked",
    ).orderBy("hostname")


def last_refresh(features: DataFrame) -> DataFrame:
    return features.groupBy("server_hostname").agg(F.max("last_updated").alias("last_updated"))


def live_or_stored(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live pools of servers that answered, the stored active ones of those that did not."""
    columns = ["server_hostname", "name", "version", "vendor_daemon", "total_licenses", "used_licenses",
               "expiration_date"]
    answered = live.select("server_hostname").distinct()
    kept = stored.where("is_active").join(answered, "server_hostname", "left_anti")
    times = last_refresh(stored.where("is_active"))
    return (
        live.select(*columns, F.lit("live").alias("origin"), F.lit(None).cast("timestamp").alias("last_updated"))
        .unionByName(
            kept.select(*columns, F.lit("stored").alias("origin"))
            .join(times, "server_hostname").select(*columns, "origin", "last_updated")
        )
    )
