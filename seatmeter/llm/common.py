"""Helpers the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmeter.session import shared_dir

# A word is a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
# bytes.split() of Python divides at exactly these six.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, empty instead of null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is (lower() would also change letters outside ASCII)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; the hold-out rule of the learned operators. Null ids: null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Compute `df` once, as a Parquet table in the shared folder, and go on from there.

    Lost executors then cost a read, not a recomputation. Each call has a folder of its own. `options` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/seatmeter-llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(taken: list[str], stem: str) -> str:
    """A column name that does not clash (ignoring case) with those already there."""
    used, name = {c.lower() for c in taken}, stem
    while name.lower() in used:
        name = f"_{name}"
    return name
