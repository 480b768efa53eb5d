"""Who came and who left, from a stream of status texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seatmeter.operators import changes, extract
from seatmeter.streaming.flow import for_each, removed, stored

CAPTURE = "dump_id string, server_hostname string, at timestamp"
HELD = "dump_id string, feature_name string, username string, host string"
CHANGE = ("server_hostname string, feature_name string, username string, host string, change string, "
          "seen_at timestamp, dump_id string")


class CheckoutWatch:
    """foreachBatch target that stores the changes of `checkout_changes` as the captures arrive.

    State is the last answered capture of every server and its holders, as a table per micro-batch; the next capture is
    compared with it. A capture that is older than it cannot be placed any more: it is kept in `late`, and changes
    nothing. A repeated micro-batch replaces its own output.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch_id={batch_id}"

    def changes(self, spark: SparkSession) -> DataFrame:
        return stored(spark, CHANGE, [f"{self.folder}/changes"])

    def late(self, spark: SparkSession) -> DataFrame:
        return stored(spark, CAPTURE, [f"{self.folder}/late"])

    def _written(self, rows: DataFrame, schema: str, kind: str, batch_id: int) -> DataFrame:
        path = self._path(kind, batch_id)
        rows.write.mode("overwrite").parquet(path)
        return stored(rows.sparkSession, schema, [path])

    def __call__(self, dumps: DataFrame, batch_id: int) -> None:
        spark = dumps.sparkSession
        parsed = extract.Parsed(dumps)
        answered = self._written(changes.captures_of(parsed.status()), CAPTURE, "captures", batch_id)
        held = self._written(parsed.checkouts().select("dump_id", *changes.HOLDING[1:]).distinct(), HELD,
                             "held", batch_id)
        last = stored(spark, CAPTURE, [self._path("last", batch_id - 1)])
        holding = stored(spark, HELD, [self._path("holding", batch_id - 1)])
        known = last.select(F.col("server_hostname").alias("k_server"), F.struct("at", "dump_id").alias("k_last"))
        placed = answered.join(known, F.col("server_hostname").eqNullSafe(F.col("k_server")), "left")
        too_late = F.coalesce(F.struct("at", "dump_id") <= F.col("k_last"), F.lit(False))
        placed.where(too_late).select(*answered.columns).write.mode("overwrite").parquet(self._path("late", batch_id))
        captures = last.unionByName(placed.where(~too_late).select(*answered.columns))
        holders = holding.unionByName(held)
        # What the last capture of an earlier batch shows has been told before.
        told = last.select("dump_id", F.lit("present").alias("change"))
        found = changes.checkout_changes(captures, holders).join(told, ["dump_id", "change"], "left_anti")
        found.select(*[c.split()[0] for c in CHANGE.split(", ")]).write.mode("overwrite").parquet(
            self._path("changes", batch_id))
        newest = captures.groupBy("server_hostname").agg(F.max(F.struct("at", "dump_id")).alias("last")).select(
            "last.dump_id", "server_hostname", "last.at")
        newest = self._written(newest, CAPTURE, "last", batch_id)
        holders.join(newest.select("dump_id"), "dump_id", "left_semi").write.mode("overwrite").parquet(
            self._path("holding", batch_id))
        for kind, old in (("captures", batch_id), ("held", batch_id), ("last", batch_id - 2), ("holding", batch_id - 2)):
            removed(spark, self._path(kind, old))


def watch_checkouts(dumps: DataFrame, folder: str, every: str | None = "5 minutes") -> StreamingQuery:
    """Changes of a stream of status texts, below `folder`."""
    return for_each(dumps, CheckoutWatch(folder), folder, every)
