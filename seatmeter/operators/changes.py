"""Changes over whole logs: the validity of every pool state, and who came and went between captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.operators.ranges import DAY, following, numbered, previous
from seatmeter.schemas import POOL_KEY
from seatmeter.session import settle

HOLDING = ["server_hostname", "feature_name", "username", "host"]


def pool_history(polls: DataFrame, span: str = "month") -> DataFrame:
    """Every state of every pool with the time from which and to which it held (`valid_to` null: until now).

    A server's polls of one `polled_at` are one round; a pool's state in it is that of its last poll. Rounds with equal
    states that follow each other are one interval. A round of the server that does not list the pool makes it unlisted
    (listed false, no counts) until it is listed again. Pools begin with their first listing.
    """
    rounds = polls.select("server_hostname", F.col("polled_at").alias("at")).where("at IS NOT NULL").distinct()
    rounds = numbered(rounds, ["server_hostname"], "at", [], "round", span)
    rounds = following(rounds, ["server_hostname"], "at", [], F.struct("at"), "next", span)
    states = polls.where("polled_at IS NOT NULL").groupBy(*POOL_KEY, F.col("polled_at").alias("at")).agg(
        F.max(F.struct("poll_id", "total_licenses", "used_licenses")).alias("last"))
    states = states.select(*POOL_KEY, "at", F.col("last.total_licenses").alias("total_licenses"),
                           F.col("last.used_licenses").alias("used_licenses"))
    rounds = settle(rounds.select(F.col("server_hostname").alias("r_server"), F.col("at").alias("r_at"), "round",
                                  F.col("next.at").alias("next_at")))
    states = states.join(rounds, F.col("server_hostname").eqNullSafe(F.col("r_server")) & (F.col("at") == F.col("r_at")))
    state = ["total_licenses", "used_licenses"]
    # What is read twice by the next steps is computed once.
    states = settle(previous(states, POOL_KEY, "at", [], F.struct("round", "next_at", *state), "before", span))
    gap = F.col("before.round") + 1 < F.col("round")
    same = F.struct(*state).eqNullSafe(F.struct(*[F.col(f"before.{c}") for c in state]))
    listed = F.struct("at", F.lit(True).alias("listed"), *state)
    unlisted = lambda at: F.struct(
        at.alias("at"), F.lit(False).alias("listed"), *[F.lit(None).cast("int").alias(c) for c in state])
    begins = F.col("before").isNull() | gap | ~same
    points = F.filter(F.array(F.when(gap, unlisted(F.col("before.next_at"))), F.when(begins, listed)),
                      lambda x: x.isNotNull())
    last = states.groupBy(*POOL_KEY).agg(F.max_by("next_at", "round").alias("next_at"))
    changes = states.select(*POOL_KEY, F.inline(points)).unionByName(
        last.where("next_at IS NOT NULL").select(*POOL_KEY, F.inline(F.array(unlisted(F.col("next_at"))))))
    changes = following(changes, POOL_KEY, "at", [], F.struct("at"), "next", span)
    return changes.select(*POOL_KEY, F.col("at").alias("valid_from"), F.col("next.at").alias("valid_to"), "listed", *state)


def captures_of(status: DataFrame) -> DataFrame:
    """(dump_id, server_hostname, at) of the captures that answered; a failed one tells nothing about who holds what."""
    return status.where((F.col("service") != "down") & F.col("last_checked").isNotNull()).select(
        "dump_id", F.col("hostname").alias("server_hostname"), F.col("last_checked").alias("at"))


def checkout_changes(captures: DataFrame, checkouts: DataFrame, span: str = DAY) -> DataFrame:
    """Who came and who left between successive captures of a server: the difference of their sets of holders.

    `captures`: dump_id, server_hostname, at; `checkouts`: dump_id, feature_name, username, host. A server's captures are
    taken by time, then id. present: the holder is in the server's first capture; appeared: in a capture but not in the
    one before; left: in the one before but not in this one. A user with several licenses of a feature on one host is
    one holder. Sets are never gathered: a holder's captures are numbered, and a gap in the numbers is a change.
    """
    order = numbered(captures, ["server_hostname"], "at", ["dump_id"], "n", span)
    order = settle(following(order, ["server_hostname"], "at", ["dump_id"], F.struct("at", "dump_id"), "next", span))
    held = checkouts.select("dump_id", *HOLDING[1:]).distinct().join(order, "dump_id")
    seen = settle(previous(settle(held), HOLDING, "at", ["dump_id"], F.struct("n"), "before", span))
    seen = following(seen, HOLDING, "at", ["dump_id"], F.struct("n"), "after", span)
    came = F.coalesce(F.col("before.n") + 1 != F.col("n"), F.lit(True))
    went = F.col("next").isNotNull() & F.coalesce(F.col("after.n") != F.col("n") + 1, F.lit(True))
    change = lambda kind, at, dump: F.struct(kind.alias("change"), at.alias("seen_at"), dump.alias("dump_id"))
    kind = F.when(F.col("n") == 1, "present").otherwise("appeared")
    return seen.select(*HOLDING, F.inline(F.filter(F.array(
        F.when(came, change(kind, F.col("at"), F.col("dump_id"))),
        F.when(went, change(F.lit("left"), F.col("next.at"), F.col("next.dump_id")))), lambda x: x.isNotNull())))
