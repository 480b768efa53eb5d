"""Captured status texts, as files of one capture or as bundles of many.

One file per capture lies below `<folder>/<server type>/<host>/<yyyyMMddHHmmss>.txt`. Very many small files are slow to
list and to open, so captures can also be kept in bundles: text files of records that end with the ASCII record separator
(0x1E, which no status text contains), each a header line `<id> <server type> <microseconds since 1970> <host>` and the
text. Bundles are split among tasks like any text file; compressed by gzip they take less than a tenth of the space, and each
is read by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmeter.session import SHUFFLE_FILES_GO, with_settings

# Fixed value: where a capture lies below the folder.
_PATH = r"/(flexlm|rlm)/([^/]+)/(\d{14})[^/]*$"


RECORD_END = "\x1e"


def write_bundles(dumps: DataFrame, folder: str, compression: str = "none") -> None:
    """Append captures as bundles, one to a partition. Nulls in the header are written as `-`, and a null text as an empty one."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    header = F.concat_ws(" ", F.regexp_replace(part("dump_id"), r"\s", "_"), F.regexp_replace(part("server_type"), r"\s", "_"),
                         F.coalesce(F.unix_micros("captured_at").cast("string"), F.lit("-")), part("host"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), RECORD_END, "")
    records = dumps.select(F.concat(header, F.lit("\n"), body).alias("value"))
    with with_settings(dumps.sparkSession, SHUFFLE_FILES_GO):
        records.write.mode("append").option("lineSep", RECORD_END).text(folder, compression=compression)


def _unbundled(records: DataFrame) -> DataFrame:
    head, value = F.substring_index("value", "\n", 1), F.col("value")
    part = lambda i: F.nullif(F.get(F.split(head, " ", 4), F.lit(i)), F.lit("-"))
    return records.where(F.contains(value, F.lit("\n"))).select(
        part(0).alias("dump_id"), part(3).alias("host"), part(1).alias("server_type"),
        F.timestamp_micros(part(2).try_cast("long")).alias("captured_at"),
        F.substr(value, F.length(head) + 2).alias("text"))


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record; records without a header line are passed over."""
    return _unbundled(spark.read.option("lineSep", RECORD_END).text(folder))


def stream_bundles(spark: SparkSession, folder: str, files_per_trigger: int = 1000,
                   bytes_per_trigger: int | None = None) -> DataFrame:
    """A micro-batch takes whole bundles: `bytes_per_trigger` of them as they lie there, at least one, else a number of files."""
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    reader = spark.readStream.option("lineSep", RECORD_END).option(*limit)
    return _unbundled(reader.text(folder))


def _described(texts: DataFrame) -> DataFrame:
    path = F.url_decode(F.col("path"))
    return texts.select(
        F.col("path").alias("dump_id"),
        F.regexp_extract(path, _PATH, 2).alias("host"),
        F.regexp_extract(path, _PATH, 1).alias("server_type"),
        F.try_to_timestamp(F.regexp_extract(path, _PATH, 3), F.lit("yyyyMMddHHmmss")).alias("captured_at"),
        F.col("value").alias("text"),
    )


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """One row per capture. Texts are parsed where they are read; only fields of their lines are shuffled afterwards."""
    texts = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return _described(texts)


def stream_dumps(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    texts = (
        spark.readStream.option("wholetext", True).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger).text(folder)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return _described(texts)
