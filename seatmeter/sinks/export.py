"""Result tables laid out for CSV or JSON files. Every section goes to its own new directory."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.operators import inventory, usage
from seatmeter.session import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _text(name: str):
    return F.col(name).cast("string")


# The column headings of the CSV layouts below.


def servers_layout(servers: DataFrame) -> DataFrame:
    return servers.select(
        _text("id").alias("ID"), F.col("hostname").alias("Hostname"), F.col("description").alias("Description"),
        F.col("type").alias("Type"), F.col("webui").alias("WebUI"),
        m.rfc3339(F.col("created_at")).alias("Created At"), m.rfc3339(F.col("updated_at")).alias("Updated At"),
    )


def features_layout(features: DataFrame) -> DataFrame:
    free = m.available_clamped(F.col("total_licenses"), F.col("used_licenses"))
    return features.select(
        F.col("server_hostname").alias("Server"), F.col("name").alias("Feature"), F.col("version").alias("Version"),
        F.col("vendor_daemon").alias("Vendor Daemon"), _text("total_licenses").alias("Total Licenses"),
        _text("used_licenses").alias("Used Licenses"), free.cast("string").alias("Available"),
        F.date_format("expiration_date", "yyyy-MM-dd").alias("Expiration Date"),
        m.rfc3339(F.col("last_updated")).alias("Last Updated"),
    )


def utilization_layout(utilization: DataFrame) -> DataFrame:
    return utilization.select(
        F.col("server_hostname").alias("Server"), F.col("feature_name").alias("Feature"),
        F.col("version").alias("Version"), F.col("vendor_daemon").alias("Vendor Daemon"),
        _text("total_licenses").alias("Total Licenses"), _text("used_licenses").alias("Used Licenses"),
        _text("available_licenses").alias("Available"), m.fixed(F.col("utilization_pct"), 2).alias("Utilization %"),
    )


def history_layout(history: DataFrame) -> DataFrame:
    return history.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), _text("users_count").alias("Users Count")
    )


def stats_layout(stats: DataFrame) -> DataFrame:
    return stats.select(
        F.col("server_hostname").alias("Server"), F.col("feature_name").alias("Feature"),
        m.fixed(F.col("avg_usage"), 2).alias("Avg Usage"), _text("peak_usage").alias("Peak Usage"),
        _text("min_usage").alias("Min Usage"), _text("total_licenses").alias("Total Licenses"),
        m.fixed(F.col("avg_utilization_pct"), 2).alias("Avg Utilization %"),
    )


def write_csv(rows: DataFrame, folder: str) -> str:
    rows.write.csv(folder, header=True, emptyValue="")
    return folder


def write_json(rows: DataFrame, folder: str, as_of: datetime, **details) -> str:
    """JSON lines below `rows`, and one line with time, count and the request's parameters below `about`."""
    rows.write.json(f"{folder}/rows")
    written = rows.sparkSession.read.schema(rows.schema).json(f"{folder}/rows")
    about = written.agg(
        F.count(F.lit(1)).alias("count"), m.rfc3339(m.moment(as_of)).alias("exported_at"),
        *[F.lit(value).alias(name) for name, value in details.items()],
    )
    about.write.json(f"{folder}/about")
    return folder


def read_csv_text(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """An exported CSV as text columns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(folder)


def combined_report(servers: DataFrame, features: DataFrame, samples: DataFrame, as_of: datetime, days: int = 30,
                    server: str | None = None) -> dict[str, DataFrame]:
    """The sections of the utilization report."""
    current = inventory.current_utilization(features, server)
    totals = servers.sparkSession.range(1).select(
        F.lit("license_utilization").alias("report_type"), m.rfc3339(m.moment(as_of)).alias("generated_at"),
        F.lit(days).alias("period_days"), F.lit(server or "").alias("server_filter"),
        servers.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_servers"),
        current.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_features"),
    )
    return {
        "summary": totals,
        "servers": servers,
        "utilization": current,
        "statistics": usage.usage_stats(samples, features, as_of, days, server),
        "heatmap": usage.heatmap_documents(samples, as_of, days, server),
    }


def write_report_csv(report: dict[str, DataFrame], folder: str) -> str:
    """The two tabular sections with the report's shorter column lists."""
    write_csv(utilization_layout(report["utilization"]).drop("Vendor Daemon"), f"{folder}/utilization")
    write_csv(stats_layout(report["statistics"]).drop("Avg Utilization %"), f"{folder}/statistics")
    return folder


def write_report_json(report: dict[str, DataFrame], folder: str) -> str:
    for section, rows in report.items():
        rows.write.json(f"{folder}/{section}")
    return folder

