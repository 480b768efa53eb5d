"""Alert throttle on a stream, and the dispatch of queued alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seatmeter.operators import alerts as queue
from seatmeter.streaming.flow import for_each, removed, stored

_ALERT = "hostname string, type string, datetime timestamp, feature_name string, message string"
_KEY = ["hostname", "type"]


def first_after(interval_minutes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps, of rows sorted by key and time, those at least the interval after the key's last kept one (or `last`)."""
    gap = interval_minutes * 60_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, None
        for batch in batches:
            at, last = (batch.column(c).cast(pa.int64()).to_pylist() for c in ("datetime", "last"))
            kept = []
            for place, now in enumerate(zip(*(batch.column(c).to_pylist() for c in _KEY))):
                if now != key:
                    key, free = now, None if last[place] is None else last[place] + gap
                if free is None or at[place] >= free:
                    kept.append(place)
                    free = at[place] + gap
            if kept:
                yield batch.take(pa.array(kept))

    return run


class Throttle:
    """foreachBatch target that lets the first alert of a (host, type) pass and the next one only after the interval.

    All alerts of one check carry the same time, and at most one of them can pass: they are reduced to one row per
    key and time first, on the map side, so a busy host is spread over many tasks. Distinct times are sorted by key and
    time and read in that order; a task holds one time, that of the key's last passing alert, whatever the key's number
    of alerts. The result does not depend on how rows are split into files, batches of a task or partitions. State is
    the last passing time of each key, as a table per micro-batch.

    An alert older than the last one that passed in an earlier micro-batch cannot pass any more (an alert counts as
    recent when it lies after the time minus the interval). Such alerts, and those without a time, are kept in `late`,
    none is dropped.
    A repeated micro-batch replaces its own output.
    """

    def __init__(self, folder: str, interval_minutes: int) -> None:
        self.folder, self.interval = folder, interval_minutes

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch_id={batch_id}"

    def passing(self, spark: SparkSession) -> DataFrame:
        return stored(spark, _ALERT, [f"{self.folder}/passing"])

    def late(self, spark: SparkSession) -> DataFrame:
        return stored(spark, _ALERT, [f"{self.folder}/late"])

    def __call__(self, candidates: DataFrame, batch_id: int) -> None:
        spark = candidates.sparkSession
        if self.interval <= 0:
            candidates.select("hostname", "type", "datetime", "feature_name", "message").write.mode("overwrite").parquet(
                self._path("passing", batch_id))
            return
        known = stored(spark, "hostname string, type string, last timestamp", [self._path("last", batch_id - 1)])
        # One row per key and time, read three times below.
        once_path = self._path("once", batch_id)
        once = candidates.groupBy(*_KEY, "datetime").agg(F.min(F.struct("feature_name", "message")).alias("first"))
        once = once.select(*_KEY, "datetime", "first.*").join(known, _KEY, "left")
        once.write.mode("overwrite").parquet(once_path)
        once = spark.read.schema(once.schema).parquet(once_path)
        too_late = F.col("datetime").isNull() | F.coalesce(F.col("datetime") < F.col("last"), F.lit(False))
        once.where(too_late).drop("last").write.mode("overwrite").parquet(self._path("late", batch_id))
        ordered = once.where(~too_late).repartition(*_KEY).sortWithinPartitions(*_KEY, "datetime")
        passed = ordered.mapInArrow(first_after(self.interval), once.schema)
        passed.drop("last").write.mode("overwrite").parquet(self._path("passing", batch_id))

        now = stored(spark, _ALERT, [self._path("passing", batch_id)]).select(*_KEY, F.col("datetime").alias("last"))
        now.union(known).groupBy(*_KEY).agg(F.max("last").alias("last")).write.mode("overwrite").parquet(
            self._path("last", batch_id))
        removed(spark, once_path)
        removed(spark, self._path("last", batch_id - 2))


def throttle(candidates: DataFrame, folder: str, interval_minutes: int = 60,
             every: str | None = "1 minute") -> StreamingQuery:
    """Throttle a stream of `hostname, type, datetime, feature_name, message` into `folder`."""
    return for_each(candidates, Throttle(folder, interval_minutes), folder, every)


class Dispatcher:
    """Renders the unsent alerts of one queue snapshot and writes the next snapshot with them marked sent.

    Delivery itself happens outside: `delivered` names the ids whose messages went out, the others stay in
    the queue. Output directories carry the run's id, so a repeated run replaces its own output.
    """

    def __init__(self, folder: str, to: list[str], critical_to: list[str]) -> None:
        self.folder, self.to, self.critical_to = folder, to, critical_to

    def render(self, alerts: DataFrame, run_id: int) -> DataFrame:
        path = f"{self.folder}/messages/run_id={run_id}"
        messages = queue.alert_messages(alerts, self.to, self.critical_to)
        messages.write.mode("overwrite").parquet(path)
        return alerts.sparkSession.read.schema(messages.schema).parquet(path)

    def settle(self, alerts: DataFrame, delivered: DataFrame, as_of: datetime, run_id: int) -> DataFrame:
        path = f"{self.folder}/alerts/run_id={run_id}"
        queue.mark_sent(alerts, delivered.select(F.col("id")), as_of).write.mode("overwrite").parquet(path)
        return alerts.sparkSession.read.schema(alerts.select(*queue.ALERT_COLUMNS).schema).parquet(path)
