"""The corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of the documents; the last one returns the pieces of the
packed sequences with their token ids, so training reads a sequence as its pieces in the order of their offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmeter.llm import mil, mixing, packing, quality_rules, simhash
from seatmeter.llm.common import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality_rules.apply_rules(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half go. The model is learned from the labelled documents of this stage."""
    return mil.rejected_removed(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.near_duplicates_removed(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to more even weights, each document once at least and twice at most."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their ids, sequence and offset. `copy` numbers the rows that were packed, as a
    document may be there twice."""
    docs = docs.select("doc_id", "text").withColumn("copy", F.monotonically_increasing_id())
    return packing.packed_ids(docs, also=("copy",))


STAGES = [
    ("quality rules", quality),
    ("quality classifier", classifier),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

# The classifier's weights and the token ids cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
