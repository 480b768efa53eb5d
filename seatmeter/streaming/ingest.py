"""Continuous collection: status texts to inventory and usage samples."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seatmeter.functions import metrics as m
from seatmeter.operators import extract, inventory
from seatmeter.operators.inventory import first_seen_samples
from seatmeter.operators.ranges import running
from seatmeter.schemas import FEATURE_USAGE, FEATURES, SAMPLE_KEY
from seatmeter.session import attach
from seatmeter.streaming.flow import for_each, removed, stored

_STORED = f"{FEATURE_USAGE}, batch_id bigint"
_CLOSED = f"{FEATURE_USAGE}, upto bigint"
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"      # the folder of rows without a date


class SampleLog:
    """foreachBatch target that stores each sample key once, however late its rows arrive.

    Samples lie by date and, below, by micro-batch. A micro-batch is written once, then compared with the stored samples
    of its own dates only: one listing and one scan of these folders, whose rows meet the batch's keys without a shuffle
    while those fit a broadcast. There is no watermark and so no lateness that drops rows. A repeated micro-batch sees
    what was there before it and replaces its own output. Spark's own duplicate suppression is not used: of equal keys in
    a micro-batch it keeps any row, the store the one with the smallest id.

    `close` merges the micro-batches of days that are over; rows that come for such a day afterwards are stored as before.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.closed = f"{folder}.closed"

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._with_closed(spark, stored(spark, _STORED, [self.folder], self.folder), "*").drop("batch_id")

    def _with_closed(self, spark: SparkSession, open_: DataFrame, days: str) -> DataFrame:
        """Open rows with those of the closed days; what a closed day has taken in counts there."""
        closed = stored(spark, _CLOSED, [f"{self.closed}/date={days}"], self.closed)
        last = closed.groupBy(F.struct("date").alias("day")).agg(F.max("upto").alias("last"))
        # A day that was closed again lies there twice until the older copy is deleted. There are as many rows as days.
        last = F.broadcast(last)
        closed = closed.join(last, (F.struct("date") == F.col("day")) & (F.col("upto") == F.col("last")))
        open_ = open_.join(last, F.struct("date") == F.col("day"), "left").where("last IS NULL OR batch_id > last")
        columns = [c.split()[0] for c in _STORED.split(", ")]
        return open_.select(*columns).unionByName(closed.withColumn("batch_id", F.col("upto")).select(*columns))

    def before(self, spark: SparkSession, dates: list, batch_id: int) -> DataFrame:
        days = f"{{{','.join(_NO_DATE if day is None else str(day) for day in dates)}}}"
        found = stored(spark, _STORED, [f"{self.folder}/date={days}"], self.folder).where(F.col("batch_id") < batch_id)
        return self._with_closed(spark, found, days)

    def __call__(self, samples: DataFrame, batch_id: int) -> None:
        spark = samples.sparkSession
        arrived = f"{self.folder}.arrived/batch_id={batch_id}"
        first_seen_samples(samples, SAMPLE_KEY, "id", ["users_count"]).select(
            "id", *SAMPLE_KEY, "users_count", F.struct(*SAMPLE_KEY).alias("key")).write.mode("overwrite").parquet(arrived)
        first = spark.read.parquet(arrived)
        dates = [r[0] for r in first.select("date").distinct().collect()]
        if dates:
            # Keys can be null. As one struct they compare null-safely, as the grouping above does.
            known = self.before(spark, dates, batch_id).select(F.struct(*SAMPLE_KEY).alias("key"))
            seen = attach(known, first.select("key"), ["key"], "left_semi", settled=True)
            fresh = first.join(seen, "key", "left_anti").drop("key").withColumn("batch_id", F.lit(batch_id).cast("long"))
            # By day, and a day with very many rows in several files.
            (fresh.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("date", "batch_id").parquet(self.folder))
        removed(spark, arrived)

    def close(self, spark: SparkSession, before: date, batch_id: int) -> list[date]:
        """Merge what micro-batches up to `batch_id` stored for days before `before`, one file set a day.

        The merged day counts as soon as its folder is complete; only then are the folders it replaces deleted. Repeated
        after a failure, it does the rest.
        """
        open_ = stored(spark, _STORED, [self.folder], self.folder)
        ready = open_.where((F.col("date") < F.lit(before)) & (F.col("batch_id") <= batch_id))
        parts = [(r[0], r[1]) for r in ready.select("date", "batch_id").distinct().collect()]
        days = sorted({day for day, _ in parts})
        if days:
            rows = self.before(spark, days, batch_id + 1).drop("batch_id").withColumn("upto", F.lit(batch_id).cast("long"))
            (rows.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("date", "upto").parquet(self.closed))
            closed = stored(spark, _CLOSED, [self.closed], self.closed)
            for day, upto in (tuple(r) for r in closed.select("date", "upto").distinct().collect()):
                if upto < batch_id and day in days:
                    removed(spark, f"{self.closed}/date={day}/upto={upto}")
        for day, batch in parts:
            removed(spark, f"{self.folder}/date={day}/batch_id={batch}")
        return days


class Collector:
    """foreachBatch target that keeps the stored inventory and samples up to date.

    Each micro-batch writes to directories named after its id, with overwrite, and reads only what earlier batches
    wrote. A batch repeated after a failure therefore replaces its own output. The inventories of the last two batches
    are kept; samples are stored by date.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.samples = SampleLog(f"{folder}/feature_usage")

    def features_path(self, batch_id: int) -> str:
        return f"{self.folder}/features/batch_id={batch_id}"

    def features(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Inventory as of a batch; empty before the first one."""
        return stored(spark, FEATURES, [self.features_path(batch_id)])

    def usage(self, spark: SparkSession) -> DataFrame:
        return self.samples.rows(spark)

    def __call__(self, dumps: DataFrame, batch_id: int) -> None:
        spark = dumps.sparkSession
        # Extracted pools are read several times below; they are written once and read back, and so are the numbered ones.
        pools = extract.all_features(dumps).withColumn("is_active", F.lit(True))
        polled_path = f"{self.folder}/polled/batch_id={batch_id}"
        pools.write.mode("overwrite").parquet(polled_path)
        batch = self._numbered(spark.read.schema(pools.schema).parquet(polled_path), batch_id)
        numbered_path = f"{self.folder}/numbered/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(numbered_path)
        batch = spark.read.schema(batch.schema).parquet(numbered_path)

        refreshed = inventory.refresh_inventory(self.features(spark, batch_id - 1), batch)
        refreshed.write.mode("overwrite").parquet(self.features_path(batch_id))
        self.samples(batch.select(
            "id", "server_hostname", F.col("name").alias("feature_name"), F.to_date("last_updated").alias("date"),
            m.minute_text(F.col("last_updated")).alias("time"), F.col("used_licenses").alias("users_count")), batch_id)
        removed(spark, polled_path)
        removed(spark, numbered_path)
        removed(spark, self.features_path(batch_id - 2))

    @staticmethod
    def _numbered(pools: DataFrame, batch_id: int) -> DataFrame:
        """Unique ids that grow with the batch and, in it, with the capture time.

        A micro-batch of bundles has any number of texts, so the running count goes by hour.
        """
        texts = pools.groupBy("dump_id").agg(F.min("last_updated").alias("at"), F.count("*").alias("n"))
        texts = running(texts.withColumn("batch", F.lit(batch_id)), ["batch"], "at", ["dump_id"], {"upto": F.col("n")}, "hour")
        before = F.col("upto") - F.col("n")
        place = F.row_number().over(Window.partitionBy("dump_id").orderBy("name", "version", "expiration_date"))
        return (pools.join(texts.select("dump_id", before.alias("before")), "dump_id")
                .withColumn("id", F.lit(batch_id << 32) + F.col("before") + place).drop("before"))


def collect(dumps: DataFrame, folder: str, every: str | None = "5 minutes") -> StreamingQuery:
    """Start collecting from a stream of status texts; `every=None` takes what is there and stops."""
    return for_each(dumps, Collector(folder), folder, every)


def distinct_samples(samples: DataFrame, folder: str, every: str | None = "5 minutes") -> StreamingQuery:
    """Store one sample per series and minute from a stream of `id`, the sample key and `users_count`."""
    return for_each(samples, SampleLog(f"{folder}/samples"), folder, every)
