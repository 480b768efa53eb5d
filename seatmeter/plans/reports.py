"""Reports made of several tables, each as a dict of DataFrames the caller writes or shows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from seatmeter.operators import alerts as queue
from seatmeter.operators import board, capacity, forecast, retention


def dashboard(servers: DataFrame, features: DataFrame, alerts: DataFrame) -> dict[str, DataFrame]:
    return {
        "totals": board.dashboard_totals(servers, features, alerts),
        "server_types": board.server_type_distribution(servers),
        "open_alerts": queue.top_unsent(alerts),
        "servers": servers.orderBy("hostname"),
    }


def predictions(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30) -> dict[str, DataFrame]:
    return {
        "summary": forecast.predictive_summary(usage, features, as_of, days),
        "forecast": forecast.forecast(usage, features, as_of, days),
        "anomalies": forecast.anomalies(usage, features, as_of, days),
    }


def capacity_report(usage: DataFrame, features: DataFrame, as_of: datetime, days: int = 30) -> dict[str, DataFrame]:
    trended = capacity.utilization_with_trend(usage, features, as_of, days)
    summary = capacity.capacity_summary(trended, days)
    return {
        "summary": summary,
        "classes": capacity.capacity_classes(trended),
        "recommendations": capacity.capacity_recommendations(summary),
    }


def storage_report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    counted = retention.table_stats(tables)
    return {
        "tables": retention.with_row_share(counted),
        "advice": retention.storage_advice(counted, tables["features"]),
    }
