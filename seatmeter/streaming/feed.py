"""Status and alert messages by channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seatmeter.operators import extract
from seatmeter.session import SHUFFLE_FILES_GO, with_settings
from seatmeter.streaming.flow import for_each, stored

MESSAGE = "type string, channel string, timestamp timestamp, data string"
ALERT_CHANNEL = "alerts"
EVERYTHING = "all"

# While a micro-batch is written. A task has some ten thousand texts, as the lines that it sorts take many times the space of
# the compressed texts that the planner goes by.
_BATCH_SETTINGS = {**SHUFFLE_FILES_GO, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}


def _message(kind: str, channel: Column, at: Column, *data: str | Column) -> list[Column]:
    return [
        F.lit(kind).alias("type"), channel.alias("channel"), at.alias("timestamp"),
        F.to_json(F.struct(*data)).alias("data"),
    ]


def poll_messages(polls: DataFrame) -> DataFrame:
    """One message per poll on its server's channel; works on streams and tables alike."""
    channel = F.concat(F.lit("server:"), "server_hostname")
    return polls.select(*_message(
        "server_status", channel, F.col("sampled_at"), "server_hostname", "server_type", "feature_name",
        "total_licenses", "used_licenses"))


def alert_feed(alerts: DataFrame) -> DataFrame:
    return alerts.select(*_message(
        "alert", F.lit(ALERT_CHANNEL), F.col("created_at"), "server_hostname", "feature_name", "severity", "message"))


def status_messages(dumps: DataFrame) -> DataFrame:
    """One message per status text with its status, pools and checkouts. `status_feed` does this on a stream.

    The texts are read once. The lists gather what one text contains, so a single input value bounds them.
    """
    return _messages_of(_parsed(dumps))


def _parsed(dumps: DataFrame) -> extract.Parsed:
    """Read by as many tasks as their size asks for, however many bundles they come in: a compressed one is not split."""
    return extract.Parsed(dumps.repartition("dump_id"))


def _messages_of(parsed: extract.Parsed) -> DataFrame:
    status = parsed.status()
    pools = parsed.features().groupBy("dump_id").agg(
        F.collect_list(F.struct("name", "version", "total_licenses", "used_licenses")).alias("features"))
    holders = parsed.checkouts().groupBy("dump_id").agg(
        F.collect_list(F.struct("feature_name", "username", "host", "checked_out_at")).alias("users"))
    joined = status.join(pools, "dump_id", "left").join(holders, "dump_id", "left")
    channel = F.concat(F.lit("server:"), "hostname")
    return joined.select(*_message(
        "server_status", channel, F.col("last_checked"), "hostname", "service", "version", "message",
        F.coalesce("features", F.array()).alias("features"), F.coalesce("users", F.array()).alias("users")))


class StatusFeed:
    """foreachBatch target that turns status texts into messages; a repeated micro-batch replaces its own. Only the messages
    stay: the lines and shuffle files of a micro-batch are deleted with it."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, dumps: DataFrame, batch_id: int) -> None:
        with with_settings(dumps.sparkSession, _BATCH_SETTINGS):
            parsed = _parsed(dumps)
            try:
                _messages_of(parsed).write.mode("overwrite").parquet(f"{self.folder}/messages/batch_id={batch_id}")
            finally:
                parsed.remove()

    def messages(self, spark: SparkSession) -> DataFrame:
        return stored(spark, MESSAGE, [f"{self.folder}/messages"])


def status_feed(dumps: DataFrame, folder: str, every: str | None = "10 seconds") -> StreamingQuery:
    """Messages of a stream of status texts, one per text, below `folder`."""
    return for_each(dumps, StatusFeed(folder), folder, every)


def subscribed(messages: DataFrame, channels: list[str]) -> DataFrame:
    """The messages of the given channels; `all` takes every one."""
    if EVERYTHING in channels:
        return messages
    return messages.where(F.col("channel").isin(channels))
