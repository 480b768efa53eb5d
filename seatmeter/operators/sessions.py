"""Checkout events: who held a license from when to when, how many at once, and what was denied while how much was free.

Events of one feature and user are taken in the order of their time, then their id. Requests that were denied neither
begin nor end anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.operators.ranges import DAY, previous, running
from seatmeter.session import settle

HOLDER = ["feature_name", "username"]


def timed(events: DataFrame) -> DataFrame:
    """Events with their moment, `at`. Those without a date or a time cannot be placed and are left out."""
    text = F.concat(F.col("event_date").cast("string"), F.lit(" "), F.col("event_time"))
    return events.withColumn("at", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).where("at IS NOT NULL")


def checkout_sessions(events: DataFrame, span: str = DAY) -> DataFrame:
    """One row per checkout: started_at, ended_at, seconds and state, plus returns that no checkout precedes.

    returned: the user's next event is a return, which ends it. replaced: it is another checkout, which ends it too.
    held: there is none, and it has no end. unmatched: a return after a return, or as the first event; it has no start.
    """
    moves = timed(events.where(F.col("event_type").isin("IN", "OUT"))).select(*HOLDER, "at", "id", "event_type")
    moves = settle(moves)                              # read three times below
    steps = previous(moves, HOLDER, "at", ["id"], F.struct("at", "event_type"), "before", span)
    out_before = F.coalesce(F.col("before.event_type") == "OUT", F.lit(False))
    is_out = F.col("event_type") == "OUT"
    ended = steps.where(out_before | ~is_out).select(
        *HOLDER, F.when(out_before, F.col("before.at")).alias("started_at"), F.col("at").alias("ended_at"),
        F.when(is_out, "replaced").when(out_before, "returned").otherwise("unmatched").alias("state"))
    last = moves.groupBy(*HOLDER).agg(F.max(F.struct("at", "id", "event_type")).alias("last"))
    held = last.where(F.col("last.event_type") == "OUT").select(
        *HOLDER, F.col("last.at").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"),
        F.lit("held").alias("state"))
    seconds = (F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")).alias("seconds")
    return ended.unionByName(held).select(*HOLDER, "started_at", "ended_at", seconds, "state")


def concurrency(sessions: DataFrame, span: str = DAY) -> DataFrame:
    """(feature_name, at, users): how many sessions are open from a moment on, at every moment at which that changes.

    A sweep line: a start counts 1, an end -1, and equal moments are one step, so a license handed over is not held twice.
    """
    open_ = sessions.where(F.col("started_at").isNotNull())
    steps = open_.select("feature_name", F.inline(F.array(
        F.struct(F.col("started_at").alias("at"), F.lit(1).alias("step"), F.lit(1).alias("started")),
        F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("step"), F.lit(0).alias("started")))))
    steps = steps.where("at IS NOT NULL").groupBy("feature_name", "at").agg(
        F.sum("step").alias("step"), F.sum("started").alias("started"))
    return running(settle(steps), ["feature_name"], "at", [], {"users": F.col("step")}, span)


def peak_concurrency(sessions: DataFrame, span: str = DAY) -> DataFrame:
    """Per feature and day with a change: sessions started, most users at once after a change, and when first."""
    levels = concurrency(sessions, span).withColumn("day", F.to_date("at"))
    peak = F.max(F.struct("users", (-F.unix_micros("at")).alias("early"))).alias("peak")
    return levels.groupBy("feature_name", "day").agg(F.sum("started").alias("started"), peak).select(
        "feature_name", "day", "started", F.col("peak.users").alias("peak_users"),
        F.timestamp_micros(-F.col("peak.early")).alias("peak_at"))


def denials_at_capacity(events: DataFrame, polls: DataFrame, span: str = DAY) -> DataFrame:
    """Every denied request with the licenses of its feature and those in use, over all servers, as last polled by then.

    An as-of join without pairs: each poll is what it changes against the server's poll before, denials change nothing,
    and one running sum over both gives the state at each denial. `polls`: server_hostname, feature_name, sampled_at,
    poll_id, total_licenses, used_licenses. A server's polls of one moment count as its last one; a poll at the moment
    of a denial counts. Without any poll before, the numbers are null.
    """
    pool = ["server_hostname", "feature_name"]
    states = polls.where("sampled_at IS NOT NULL").groupBy(*pool, F.col("sampled_at").alias("at")).agg(
        F.max(F.struct("poll_id", "total_licenses", "used_licenses")).alias("last"))
    states = states.select(*pool, "at", F.col("last.total_licenses").alias("total"), F.col("last.used_licenses").alias("used"))
    states = previous(states, pool, "at", [], F.struct("total", "used"), "before", span)
    change = lambda name: F.coalesce(name, F.lit(0)) - F.coalesce(f"before.{name}", F.lit(0))
    none = F.lit(None)
    changes = states.groupBy("feature_name", "at").agg(
        F.sum(change("total")).alias("total"), F.sum(change("used")).alias("used")).select(
            "feature_name", "at", F.lit(0).alias("kind"), none.cast("long").alias("id"), none.cast("string").alias("username"),
            none.cast("string").alias("reason"), "total", "used", F.lit(1).alias("polls"))
    denied = timed(events.where(F.col("event_type") == "DENIED")).select(
        "feature_name", "at", F.lit(1).alias("kind"), "id", "username", "reason", F.lit(0).cast("long").alias("total"),
        F.lit(0).cast("long").alias("used"), F.lit(0).alias("polls"))
    both = running(settle(changes.unionByName(denied)), ["feature_name"], "at", ["kind", "id"], {
        "total_licenses": F.col("total"), "used_licenses": F.col("used"), "seen": F.col("polls")}, span)
    known = F.col("seen") > 0
    total, used = (F.when(known, F.col(c)) for c in ("total_licenses", "used_licenses"))
    return both.where("kind = 1").select(
        "id", "feature_name", "username", "reason", F.col("at").alias("denied_at"), total.alias("total_licenses"),
        used.alias("used_licenses"), F.when(known, F.col("used_licenses") >= F.col("total_licenses")).alias("at_capacity"))
