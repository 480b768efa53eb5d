import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatmeter.llm import chat as q
from seatmeter.llm import queries

LOG = "conversation long, seq long, message long, kind string, role string, text string"


def read(spark, events):
    """{conversation: (turns, text under the mask)} read back from the output."""
    log = spark.createDataFrame(events, LOG).withColumn("segments", F.lit("x")).withColumn("place", F.lit(1))
    out = q.formatted(log)
    return {r.conversation: ([tuple(t) for t in r.turns], r.loss) for r in out.select(
        "conversation", q.read_turns(F.col("formatted")).alias("turns"), q.read_loss(F.col("segments")).alias("loss")).collect()}


def test_events_are_folded(spark):
    got = read(spark, [
        (1, 0, 10, "start", "user", "Hel"), (1, 1, 10, "delta", None, "lo"),
        (1, 3, 11, "delta", None, "draft"), (1, 2, 11, "start", "assistant", None),
        (1, 4, 11, "regenerate", None, None), (1, 6, 11, "delta", None, "two"), (1, 5, 11, "delta", None, "one "),
        (1, 7, 12, "start", "user", "typo"), (1, 8, 12, "edit", None, "fixed"), (1, 9, 12, "delta", None, "!"),
        (1, 20, 13, "start", "assistant", "a"), (1, 21, 10, "edit", None, "Hello again")])
    assert got[1] == ([("user", "Hello again"), ("assistant", "one two"), ("user", "fixed!"), ("assistant", "a")], "one twoa")


def test_edges(spark):
    got = read(spark, [(None, 1, 1, "start", None, None), (2, None, 1, "start", "assistant", None),
                       (3, 1, 1, "delta", None, "x"), (3, 1, 1, "delta", None, "x"), (3, 2, 1, None, None, "y"),
                       (4, 5, 1, "start", "tool", "z" * 200_000)])
    assert got[None] == ([("", "")], "") and got[2] == ([("assistant", "")], "")
    assert got[3] == ([("", "xxy")], "") and len(got[4][0][0][1]) == 200_000
    assert read(spark, []) == {}


def test_long_conversation_in_order(spark):
    events = [(1, i, i, "start", "assistant" if i % 2 else "user", f"t{i}") for i in range(3 * q.STRETCH)]
    turns, loss = read(spark, events)[1]
    assert [t[1] for t in turns] == [f"t{i}" for i in range(3 * q.STRETCH)]
    assert loss == "".join(f"t{i}" for i in range(1, 3 * q.STRETCH, 2))


HARD = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "<", "[", " [/INST]", "/s>", "s>", "INST]", "\n", "<\\\\/s>", "é"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(HARD), max_size=6), st.lists(st.sampled_from(HARD), max_size=8)),
                min_size=20, max_size=40))
def test_escaping_is_reversible(spark, parts):
    turns = [("".join(a), "".join(b)) for a, b in parts]
    got = read(spark, [(1, i, i, "start", r, t) for i, (r, t) in enumerate(turns)])[1]
    assert got[0] == turns


@pytest.mark.parametrize("text", HARD)
def test_no_control_string_is_left_inside(spark, text):
    row = spark.range(1).select(q.escaped(F.lit(text)).alias("e")).first()
    assert not any(c in row.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_digest(spark):
    log = spark.createDataFrame([(1, 0, 0, "start", "user", "<s>é"), (1, 1, 1, "start", "assistant", "</s>😀")], LOG)
    r = q.digest(q.formatted(log)).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r.n_turns, r.turns_sha256) == (2, sha("user\n<s>é\nassistant\n</s>😀\n"))
    assert (r.loss_chars, r.loss_sha256) == (5, sha("</s>😀"))
    assert r.formatted_chars == len("<s>[INST] user [/INST]<\\s>é</s><s>[INST] assistant [/INST]<\\/s>😀</s>")


def test_no_python_in_the_plan(spark):
    log = spark.createDataFrame([(1, 0, 0, "start", "user", "x")], LOG).cache()
    log.count()
    plan = q.digest(q.formatted(log))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_events_of_a_table_hold_every_kind_and_null_turns_keep_their_order(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"zzzz aaaa {c} {t}") for c in range(6) for t in range(9)]
    rows += [(7, None, "user", "zzzz aaaa"), (7, None, "user", "yyyy bbbb"), (7, 0, "assistant", "mmmm"), (8, 1, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    log = queries._events(table)
    assert {r.kind for r in log.collect()} == {"start", "delta", "edit", "regenerate"}
    got = {r.conversation: [tuple(t) for t in r.turns] for r in q.formatted(log).select(
        "conversation", q.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got[3] == [(r, t) for c, _, r, t in rows if c == 3]
    assert got[7] == [("user", "yyyy bbbb"), ("user", "zzzz aaaa"), ("assistant", "mmmm")] and got[8] == [("user", "")]
    assert got[-1] == [("user", queries._CONTROL), ("assistant", queries._CONTROL)]
