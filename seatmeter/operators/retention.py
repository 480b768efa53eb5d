"""Row counts, retention counts, advice and age-based cleanup of the stored tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.functions.texts import STORAGE_ACTIONS, advice
from seatmeter.operators.stats import unfold_advice
from seatmeter.operators.usage import first_day, first_whole_day
from seatmeter.schemas import TABLES
from seatmeter.session import settle
from seatmeter.sources.tables import DAY_COLUMN, read_by_day, write_by_day
from seatmeter.streaming.flow import removed

# Estimated size of a stored sample, and the row counts above which advice is given.
BYTES_PER_SAMPLE = 100
LARGE_USAGE_ROWS = 1_000_000
MANY_INACTIVE = 100


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, date span of the usage table. Missing tables are skipped. `stored_table_stats` answers the same
    from file footers."""
    day = {"feature_usage": "date"}
    parts = []
    for name, table in tables.items():
        span = F.col(day[name]) if name in day else F.lit(None).cast("date")
        parts.append(table.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
            F.min(span).alias("oldest_record"), F.max(span).alias("newest_record"),
        ))
    return reduce(DataFrame.unionByName, parts)


def stored_table_stats(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    """`table_stats` of stored Parquet tables without reading rows: counts come from the file footers.

    The usage table lies by day, so its span is that of the days that hold a row. Spark answers aggregates from footers
    only in its newer Parquet reader: the tables are read in a session of their own, with that reader switched on, and no
    setting of the caller's session changes.
    """
    reader = spark.newSession()
    reader.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    reader.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    parts = []
    for name in names:
        try:
            table = reader.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        count = F.count(F.lit(1)).alias("rows")
        if name == "feature_usage":
            parts.append(table.groupBy("date").agg(count).agg(
                F.lit(name).alias("table_name"), F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
                F.min("date").alias("oldest_record"), F.max("date").alias("newest_record")))
        else:
            none = F.lit(None).cast("date")
            parts.append(table.agg(count).select(
                F.lit(name).alias("table_name"), F.col("rows").alias("row_count"), none.alias("oldest_record"),
                none.alias("newest_record")))
    if not parts:
        return spark.createDataFrame([], "table_name string, row_count long, oldest_record date, newest_record date")
    return reduce(DataFrame.unionByName, parts)


def with_row_share(stats: DataFrame) -> DataFrame:
    """Adds rows as percent of the largest table; the window spans one row per table, six at most."""
    largest = F.max("row_count").over(Window.partitionBy(F.lit(0)))
    return stats.withColumn("row_share_pct", m.percent_of(F.col("row_count"), largest))


def retention_stats(usage: DataFrame, events: DataFrame, alerts: DataFrame, as_of: datetime) -> DataFrame:
    """Row counts by age. One pass per table; the rows older than 90 days are what cleanup could save."""

    def counts(table: DataFrame, **columns: Column) -> DataFrame:
        return table.agg(F.struct(*[c.alias(n) for n, c in columns.items()]).alias("counts"))

    def younger(column: str, days: int) -> Column:
        return F.count_if(F.col(column) >= F.lit(first_day(as_of, days)))

    rows = F.count(F.lit(1))
    used = counts(usage, total=rows, d30=younger("date", 30), d90=younger("date", 90), d365=younger("date", 365))
    seen = counts(events, total=rows, d30=younger("event_date", 30))
    raised = counts(alerts, total=rows, sent=F.count_if("sent"))
    gathered = usage.sparkSession.range(1).select(
        used.scalar().alias("usage"), seen.scalar().alias("events"), raised.scalar().alias("alerts")
    )
    old = F.greatest(F.col("usage.total") - F.col("usage.d90"), F.lit(0))
    return gathered.select(
        F.col("usage.total").alias("usage_records_total"), F.col("usage.d30").alias("usage_records_30_days"),
        F.col("usage.d90").alias("usage_records_90_days"), F.col("usage.d365").alias("usage_records_365_days"),
        F.col("events.total").alias("events_total"), F.col("events.d30").alias("events_30_days"),
        F.col("alerts.total").alias("alerts_total"), F.col("alerts.sent").alias("alerts_sent"),
        old.alias("potential_savings_rows"), (old * BYTES_PER_SAMPLE).alias("potential_savings_bytes"),
        F.when(old > 0, m.bytes_text(old * BYTES_PER_SAMPLE)).otherwise("").alias("potential_savings_human"),
    )


def expired(table: str, as_of: datetime, days: int) -> Column:
    """Which rows an age-based cleanup deletes. Day columns compare at their midnight."""
    cutoff = as_of - timedelta(days=days)
    first_kept = first_whole_day(as_of, days)
    if table == "feature_usage":
        return F.col("date") < F.lit(first_kept)
    if table == "license_events":
        return F.col("event_date") < F.lit(first_kept)
    if table == "alerts":
        return (F.col("created_at") < m.moment(cutoff)) & F.col("sent")
    if table == "alert_events":
        return F.col("datetime") < m.moment(cutoff)
    raise ValueError(f"cleanup not supported for table: {table}")


def cleaned(table: DataFrame, name: str, as_of: datetime, days: int) -> DataFrame:
    """The rows that stay. A day-partitioned table only reads the partitions it keeps."""
    return table.where(~F.coalesce(expired(name, as_of, days), F.lit(False)))


def clean_stored(spark: SparkSession, folder: str, name: str, as_of: datetime, days: int) -> DataFrame:
    """Deletes the expired rows of a table that `tables.write_by_day` wrote, and returns rows deleted and kept.

    Days after the cutoff's are not read for it, and their files are not touched. Days of which every row has expired are
    dropped as folders; of the others, only those that lose a row are written anew. Repeated after a failure, it does the
    rest: a day is replaced as a whole, or not at all.
    """
    day, table = DAY_COLUMN[name], read_by_day(spark, folder, name)
    last_day = (as_of - timedelta(days=days)).date()
    gone = F.coalesce(expired(name, as_of, days), F.lit(False))
    old = table.where(F.col(day) <= F.lit(last_day))
    counts = [tuple(r) for r in old.groupBy(day).agg(F.count(F.lit(1)), F.count_if(gone)).collect()]
    partly = [d for d, count, lost in counts if 0 < lost < count]
    if partly:
        # Written aside first: a folder cannot be read and replaced by one job.
        kept = settle(old.where(F.col(day).isin(partly) & ~gone))
        write_by_day(kept.drop(day) if name in ("alerts", "alert_events") else kept, folder, name, "overwrite")
    for d, count, lost in counts:
        if lost == count:
            removed(spark, f"{folder}/{name}/{day}={d}")
    return read_by_day(spark, folder, name).agg(
        F.lit(name).alias("table_name"), F.lit(sum(lost for *_, lost in counts)).cast("long").alias("rows_deleted"),
        F.count(F.lit(1)).alias("rows_kept"))


def cleanup_counts(tables: dict[str, DataFrame], as_of: datetime, days: int) -> DataFrame:
    """Rows deleted and kept per table."""
    parts = [
        table.agg(
            F.lit(name).alias("table_name"), F.count_if(expired(name, as_of, days)).alias("rows_deleted"),
            F.count_if(~F.coalesce(expired(name, as_of, days), F.lit(False))).alias("rows_kept"),
        )
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def storage_advice(stats: DataFrame, features: DataFrame, large_usage: int = LARGE_USAGE_ROWS,
                   many_inactive: int = MANY_INACTIVE) -> DataFrame:
    """Advice from the size of the usage table and the number of pools no longer listed."""
    inactive = features.agg(F.count_if(~F.col("is_active")).alias("inactive")).scalar()
    name, rows, gone = F.col("table_name"), F.col("row_count"), F.col("inactive_features")
    rules = [
        ((name == "feature_usage") & (rows > large_usage), advice("large_usage", rows)),
        ((name == "features") & (gone > many_inactive), advice("many_inactive", gone)),
    ]
    actions = F.create_map(*[F.lit(text) for pair in STORAGE_ACTIONS.items() for text in pair])
    counted = stats.withColumn("inactive_features", inactive)
    return unfold_advice(counted, ["table_name"], rules).withColumn(
        "action", F.element_at(actions, F.col("type")))
