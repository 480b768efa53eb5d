"""Stored tables, from files or from a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmeter.schemas import TABLES


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One of the six stored tables below `folder`, with its declared schema."""
    reader = spark.read.schema(TABLES[name]).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{folder}/{name}")


# The day a row of an aging table belongs to, which its folder is named after.
DAY_COLUMN = {"feature_usage": "date", "license_events": "event_date", "alerts": "created_on", "alert_events": "raised_on"}
_DAY_OF = {"alerts": "created_at", "alert_events": "datetime"}


def write_by_day(rows: DataFrame, folder: str, name: str, mode: str = "append") -> None:
    """An aging table with one folder per day; mode `overwrite` replaces the days that `rows` has, and no others."""
    day = DAY_COLUMN[name]
    if name in _DAY_OF:
        rows = rows.withColumn(day, F.to_date(_DAY_OF[name]))
    (rows.hint("rebalance", day).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(day)
     .parquet(f"{folder}/{name}"))


def read_by_day(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that `write_by_day` wrote, with its day column."""
    schema = TABLES[name] if name not in _DAY_OF else f"{TABLES[name]}, {DAY_COLUMN[name]} date"
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def write_usage(usage: DataFrame, folder: str) -> None:
    """Append samples, one directory per day, each file ordered by series for min/max skipping."""
    (
        usage.repartition("date", F.pmod(F.hash("server_hostname", "feature_name"), F.lit(32)))
        .sortWithinPartitions("date", "server_hostname", "feature_name", "time")
        .write.mode("append").partitionBy("date").parquet(f"{folder}/feature_usage")
    )


def read_jdbc(spark: SparkSession, url: str, name: str, partitions: int = 1, lower: int = 0, upper: int = 0,
              **options: str) -> DataFrame:
    """A table of a running SQLite, PostgreSQL or MySQL database (its driver must be on the class path).

    With `partitions` > 1 the id range [lower, upper] is read in that many parallel slices; rows outside
    the range still arrive, in the first or last slice.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, name, partitions, lower, upper, **options)).load()


def jdbc_options(url: str, name: str, partitions: int = 1, lower: int = 0, upper: int = 0,
                 **options: str) -> dict[str, str]:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    chosen = {"url": url, "dbtable": name, "customSchema": TABLES[name], "fetchsize": "10000", **options}
    if partitions > 1:
        chosen.update(partitionColumn="id", lowerBound=str(lower), upperBound=str(upper),
                      numPartitions=str(partitions))
    return chosen


def read_servers(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The configured license servers; `type` is lower-cased as the type check expects."""
    reader = spark.read.schema(TABLES["servers"]).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path).withColumn("type", F.lower(F.trim("type")))
