"""Chat formatting from event logs, with DataFrame functions only.

A log has rows (conversation, seq, message, kind, role, text). The events of a message, sorted by seq, are folded into
its final text:

    start        begins the message (a role, and possibly a first text)
    delta        appends a streamed piece
    edit         replaces everything so far; later deltas append to it
    regenerate   throws away everything so far; later deltas build the text anew

Messages stand in the order of their first events. A turn is rendered as

    <s>[INST] role [/INST]text</s>

and the control strings inside roles and texts are escaped: a backslash after the opening bracket, one more where some
are there already, so that unescaping is exact. The result is a list of segments with a loss flag; only the texts of
assistant turns carry loss. The formatted text is the segments joined.

One shuffle brings a message's events together, the next a stretch of `STRETCH` seq numbers of a conversation, the last
the stretches of a conversation: a very long conversation is folded and rendered in many tasks, and only its finished
stretches meet, as they are one text in the result.

Defined cases: a null text is empty, a null role is the empty role. A message without start, edit or regenerate is its
deltas. Of events with equal seq, the order is kind, then text; repeated events count as often as they occur. A null
conversation id is a conversation of its own; a null seq sorts first. Extra columns are ignored. An empty log gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
STRETCH = 1024
ESCAPE = (r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"$1$2$3")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def folded(events: DataFrame) -> DataFrame:
    """(conversation, place, role, text): one row per message, place being the seq of its first event."""
    e = events.select(
        "conversation", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"),
        "role", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind").isin("start", "edit", "regenerate")
    grouped = e.groupBy("conversation", "message").agg(
        F.min("seq").alias("place"), F.max(F.when(resets, F.col("seq"))).alias("reset"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).alias("role"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("events"))
    live = F.filter("events", lambda x: (F.col("reset").isNull() | (x["seq"] >= F.col("reset")))
                    & (x["kind"] != "regenerate"))
    return grouped.select("conversation", "place", "message", F.coalesce("role", F.lit("")).alias("role"),
                          F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def segments(role: Column, text: Column) -> Column:
    """The rendered turn as array<struct<text, loss>>."""
    part = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    return F.array(part(F.concat(F.lit(OPEN), escaped(role), F.lit(MIDDLE)), F.lit(False)),
                   part(escaped(text), role == "assistant"), part(F.lit(CLOSE), F.lit(False)))


def formatted(events: DataFrame) -> DataFrame:
    """(conversation, segments, formatted): one row per conversation."""
    turns = folded(events).select(
        "conversation", F.floor(F.col("place") / STRETCH).alias("stretch"), "place", "message",
        segments(F.col("role"), F.col("text")).alias("segments"))
    stretches = turns.groupBy("conversation", "stretch").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "message", "segments"))), lambda x: x["segments"]),
    ).alias("segments"))
    whole = stretches.groupBy("conversation").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("stretch", "segments"))), lambda x: x["segments"])).alias("segments"))
    return whole.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>: the inverse of rendering."""
    pieces = F.filter(F.split(text, CLOSE), lambda x: x != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, MIDDLE, 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(piece, F.length(head) + len(MIDDLE) + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(parts: Column) -> Column:
    """The text under the loss mask."""
    return F.array_join(F.transform(F.filter(parts, lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")


def digest(chats: DataFrame) -> DataFrame:
    """Figures read back from the output of `formatted`."""
    read = chats.select("conversation", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conversation", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
