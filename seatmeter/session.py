"""Session settings and the helpers that touch them."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table, in rows, that attach() lets every executor hold a copy of. Rows attached this way are a key
# and a few numbers (about 200 bytes), so the copy stays near 40 MB.
MAX_BROADCAST_ROWS = 200_000

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also split a hot reducer partition when that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode. Larger fused stages (the text extraction
    # has some) run faster as separate, smaller generated functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Settings only a new session can take. Capturing the Python call site of every column expression more than
# doubles the time to build a plan.
_STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


# An action's shuffle files are deleted when it ends, and not when the driver happens to collect what refers to them.
SHUFFLE_FILES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build_session(app_name: str = "seatmeter", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; `master` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **_STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold within the block only."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without the setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="seatmeter-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute `df` once into the shared folder and go on from the written copy."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def unsettle(df: DataFrame) -> None:
    """Delete the written copy of a settled `df`, which nothing reads afterwards. It needs a classic session."""
    context = df.sparkSession.sparkContext
    copy = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if copy.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(copy.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
           max_rows: int = MAX_BROADCAST_ROWS, settled: bool = False) -> DataFrame:
    """Join raw rows with a table that is usually small, without shuffling the raw rows when that is safe.

    `small` is settled and counted first. Up to `max_rows` rows it is broadcast, so a hot key on the big
    side costs nothing; beyond that both sides shuffle and AQE splits hot partitions.
    """
    small = small if settled else settle(small)
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
