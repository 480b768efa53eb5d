"""Extraction for texts of all supported server types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.operators import flexlm, rlm
from seatmeter.session import attach, settle, unsettle


def latest_dumps(dumps: DataFrame) -> DataFrame:
    """The last text of every server. Ids are compared first, so only these texts are read closely."""
    last = dumps.groupBy("host").agg(F.max_by("dump_id", F.struct("captured_at", "dump_id")).alias("dump_id"))
    return attach(dumps, last.select("dump_id"), ["dump_id"], "left_semi")


def _of_type(dumps: DataFrame, server_type: str) -> DataFrame:
    return dumps.where(F.col("server_type") == server_type)


def all_status(dumps: DataFrame) -> DataFrame:
    return flexlm.flexlm_status(_of_type(dumps, "flexlm")).unionByName(rlm.rlm_status(_of_type(dumps, "rlm")))


def all_features(dumps: DataFrame) -> DataFrame:
    return flexlm.flexlm_features(_of_type(dumps, "flexlm")).unionByName(rlm.rlm_features(_of_type(dumps, "rlm")))


def all_checkouts(dumps: DataFrame) -> DataFrame:
    return flexlm.flexlm_checkouts(_of_type(dumps, "flexlm")).unionByName(
        rlm.rlm_checkouts(_of_type(dumps, "rlm")))


class Parsed:
    """Texts whose lines are read and classified once and written, for jobs that want several of their contents. Texts of
    other types have none."""

    def __init__(self, dumps: DataFrame) -> None:
        self.flexlm = settle(flexlm.read_lines(_of_type(dumps, "flexlm")))
        self.rlm = settle(rlm.read_lines(_of_type(dumps, "rlm")))

    def status(self) -> DataFrame:
        return flexlm.status_of(self.flexlm).unionByName(rlm.status_of(self.rlm))

    def features(self) -> DataFrame:
        return flexlm.features_of(self.flexlm).unionByName(rlm.features_of(self.rlm))

    def checkouts(self) -> DataFrame:
        return flexlm.checkouts_of(self.flexlm).unionByName(rlm.checkouts_of(self.rlm))

    def remove(self) -> None:
        """Delete the written lines, when all that is made of them has been written."""
        unsettle(self.flexlm)
        unsettle(self.rlm)


def unsupported(dumps: DataFrame) -> DataFrame:
    """Texts no extraction exists for, with the reason."""
    known = F.coalesce(F.col("server_type").isin("flexlm", "rlm"), F.lit(False))
    reason = F.concat(F.lit("unsupported server type: "), F.coalesce("server_type", F.lit("")))
    return dumps.where(~known).select("dump_id", "host", reason.alias("reason"))
