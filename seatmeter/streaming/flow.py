"""Common steps of the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Write all available input to parquet below `folder` and return what was written."""
    started: StreamingQuery = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress").outputMode("append")
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def for_each(stream: DataFrame, target: Callable[[DataFrame, int], None], folder: str,
             every: str | None) -> StreamingQuery:
    """Hand every micro-batch to `target`; `every=None` takes what is there and stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (stream.writeStream.foreachBatch(target).option("checkpointLocation", f"{folder}/progress")
            .trigger(**trigger).start())


def stored(spark: SparkSession, schema: str, paths: list[str], base: str | None = None) -> DataFrame:
    """The rows of the given folders or path patterns; those that do not exist hold none."""
    reader = spark.read.schema(schema).option("ignoreMissingFiles", True)
    out = spark.createDataFrame([], schema)
    for path in paths:
        try:
            found = (reader.option("basePath", base) if base else reader).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            out = out.unionByName(found.select(*out.columns))
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of an earlier batch, where there is one. It needs a classic session, not Spark Connect."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
