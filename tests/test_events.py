"""Checkout events, changes over whole logs, cycles and peak periods: plain Python counterparts, hot keys, edges."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seatmeter.operators import changes, cycles, ranges, sessions
from seatmeter.sources.dumps import read_dumps, stream_dumps
from seatmeter.streaming import watch
from tests.test_streaming import capture

EVENTS = "id long, event_date date, event_time string, event_type string, feature_name string, username string, reason string"
POLLS = "poll_id long, server_hostname string, feature_name string, sampled_at timestamp, total_licenses int, used_licenses int"
BEGIN = datetime(2024, 3, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def event(i, at, kind, feature="f", user="u"):
    return (i, at.date(), at.strftime("%H:%M:%S"), kind, feature, user, "full" if kind == "DENIED" else "")


def log(count=3000, seed=1):
    """A third of all events are one user's of one feature."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        hot = i % 3 == 0
        at = BEGIN + timedelta(seconds=rng.randrange(12 * 86400))
        rows.append(event(i, at, rng.choice(["IN", "OUT", "OUT", "IN", "DENIED"]), "hot" if hot else f"f{rng.randrange(4)}",
                          "hot" if hot else f"u{rng.randrange(6)}"))
    return rows


def moment(row):
    return datetime.fromisoformat(f"{row[1]} {row[2]}")


def paired(rows):
    out, by = [], {}
    for r in rows:
        if r[3] != "DENIED":
            by.setdefault((r[4], r[5]), []).append((moment(r), r[0], r[3]))
    for (f, u), steps in by.items():
        before = None
        for at, _, kind in sorted(steps):
            if before and before[1] == "OUT":
                out.append((f, u, before[0], at, "replaced" if kind == "OUT" else "returned"))
            elif kind == "IN":
                out.append((f, u, None, at, "unmatched"))
            before = (at, kind)
        if before[1] == "OUT":
            out.append((f, u, before[0], None, "held"))
    return out


def levels(pairs):
    steps = {}
    for f, _, start, end, _ in pairs:
        if start:
            steps.setdefault(f, {}).setdefault(start, 0)
            steps[f][start] += 1
            if end:
                steps[f][end] = steps[f].get(end, 0) - 1
    out = {}
    for f, by in steps.items():
        total = 0
        for at in sorted(by):
            total += by[at]
            out[f, at] = total
    return out


def test_sessions_and_concurrency_with_a_hot_user(spark):
    rows = log()
    events = spark.createDataFrame(rows, EVENTS)
    found = sessions.checkout_sessions(events)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.feature_name, r.username, r.started_at, r.ended_at, r.state) for r in found.collect()), key=key)
    assert got == sorted(paired(rows), key=key) and {s for *_, s in got} == {"returned", "replaced", "unmatched", "held"}
    want = levels(got)
    assert {(r.feature_name, r.at): r.users for r in sessions.concurrency(found).collect()} == want
    peaks = {(r.feature_name, r.day): (r.peak_users, r.peak_at) for r in sessions.peak_concurrency(found).collect()}
    for (f, day), (users, at) in peaks.items():
        own = {t: n for (g, t), n in want.items() if g == f and t.date() == day}
        assert users == max(own.values()) and at == min(t for t, n in own.items() if n == users)
    plan = plan_of(sessions.peak_concurrency(found))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_windows_go_over_days_not_whole_keys(spark):
    """Rows are only ever sorted within a day of a key; windows over a key see one row per day."""
    rows = spark.createDataFrame(log(300), EVENTS)
    plan = plan_of(sessions.checkout_sessions(rows))
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_part" in line.split("Window [")[1] or "_whole" in line


def test_session_edges(spark):
    at = BEGIN
    rows = [event(2, at, "IN"), event(1, at, "OUT"), (3, None, "10:00:00", "OUT", "f", "u", ""), (4, at.date(), None, "OUT", "f", "u", ""),
            (5, at.date(), "broken", "IN", "f", "u", ""), event(6, at, "DENIED"), event(7, at, "OUT", None, None),
            event(8, at + timedelta(days=40), "IN", None, None)]
    got = {(r.feature_name, r.started_at, r.ended_at, r.seconds, r.state) for r in
           sessions.checkout_sessions(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {("f", at, at, 0, "returned"), (None, at, at + timedelta(days=40), 40 * 86400, "returned")}
    none = spark.createDataFrame([], EVENTS)
    assert sessions.checkout_sessions(none).count() == 0
    assert sessions.peak_concurrency(sessions.checkout_sessions(none)).count() == 0


def test_denials_against_the_last_polls(spark):
    """A third of the denials and polls are one feature's; two servers hold it."""
    rng = random.Random(4)
    rows = [r for r in log(900) if r[3] == "DENIED"]
    polls = [(i, f"s{rng.randrange(2)}", "hot" if i % 3 == 0 else f"f{rng.randrange(4)}",
              BEGIN + timedelta(seconds=rng.randrange(3600, 12 * 86400)), rng.randrange(1, 9), rng.randrange(9)) for i in range(600)]
    polls.append((1000, "s0", "hot", moment(rows[0]), 50, 50))
    polls.append((1001, "s0", "hot", moment(rows[0]), 60, 40))           # the last poll of a moment counts
    found = sessions.denials_at_capacity(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(polls, POLLS))
    got = {r.id: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        total, used, known = 0, 0, False
        for server in ("s0", "s1"):
            own = [p for p in polls if p[1] == server and p[2] == r[4] and p[3] <= moment(r)]
            if own:
                last = max(own, key=lambda p: (p[3], p[0]))
                total, used, known = total + last[4], used + last[5], True
        row = got[r[0]]
        assert (row.total_licenses, row.used_licenses, row.at_capacity) == ((total, used, used >= total) if known else (None,) * 3)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sessions.denials_at_capacity(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([], POLLS)).where(
        "at_capacity IS NULL").count() == len(rows)


LOG = "poll_id long, server_hostname string, name string, version string, expiration_date timestamp, total_licenses int, used_licenses int, polled_at timestamp"


def test_pool_history_with_a_hot_pool(spark):
    """Polls every few hours; one pool has a third of all, others come and go."""
    rng = random.Random(2)
    rows, i = [], 0
    for server in ("s0", "s1"):
        for k in range(150):
            at = BEGIN + timedelta(hours=7 * k)
            for pool in ["hot"] * 3 + [f"p{n}" for n in range(6) if rng.random() < 0.6]:
                if pool != "hot" or k % 50 != 7:
                    rows.append((i, server, pool, "v", None, 5, rng.randrange(2), at))
                    i += 1
    found = changes.pool_history(spark.createDataFrame(rows, LOG), span="week")
    got = {}
    for r in found.collect():
        got.setdefault((r.server_hostname, r.name), []).append((r.valid_from, r.valid_to, r.listed, r.used_licenses))
    for server in ("s0", "s1"):
        times = sorted({r[7] for r in rows if r[1] == server})
        for pool in ["hot", *(f"p{n}" for n in range(6))]:
            state = {r[7]: r[6] for r in sorted(rows) if r[1] == server and r[2] == pool}
            want, now = [], "before"
            for at in times:
                new = state.get(at, None)
                if new != now and not (now == "before" and new is None):
                    want.append((at, new is not None, new))
                    now = new
            ends = [w[0] for w in want[1:]] + [None]
            assert sorted(got[server, pool], key=lambda x: x[0]) == [(a, e, b, c) for (a, b, c), e in zip(want, ends)]
    assert changes.pool_history(spark.createDataFrame([], LOG)).count() == 0


def differences(captures, held):
    """{(server, feature, user, host, change, dump)} from the sets themselves."""
    out = set()
    for server in {c[1] for c in captures}:
        before = None
        for at, dump in sorted((c[2], c[0]) for c in captures if c[1] == server):
            now = {h[1:] for h in held if h[0] == dump}
            for h in now - (before or set()):
                out.add((server, *h, "present" if before is None else "appeared", dump))
            for h in (before or set()) - now:
                out.add((server, *h, "left", dump))
            before = now
    return out


def test_checkout_changes_with_a_hot_server(spark):
    rng = random.Random(3)
    captures = [(f"d{i}", "hot" if i % 3 == 0 else f"s{rng.randrange(5)}",
                 BEGIN + timedelta(minutes=rng.randrange(5 * 1440))) for i in range(240)]
    held = [(d, f"f{rng.randrange(2)}", f"u{u}", "h") for d, _, _ in captures for u in range(5) if rng.random() < 0.5]
    held += held[:20]
    found = changes.checkout_changes(
        spark.createDataFrame(captures, watch.CAPTURE), spark.createDataFrame(held, watch.HELD))
    got = [(r.server_hostname, r.feature_name, r.username, r.host, r.change, r.dump_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == differences(captures, set(held))
    assert {g[4] for g in got} == {"present", "appeared", "left"}


def lmstat(users):
    lines = "".join(f"    {u} pc{u} /dev/tty (v1.0) (lic/27000 100), start Fri 3/1 10:00\n" for u in users)
    return ("    lic: license server UP v11.1.1\nUsers of cad:  (Total of 9 licenses issued;  Total of 1 licenses in use)\n"
            f'  "cad" v1.0, vendor: acme\n  floating license\n{lines}')


def test_watch_equals_the_batch(spark, tmp_path):
    """Captures in three micro-batches; the third also brings one from before, and one that failed."""
    steps = [[("20240301100000", "ab"), ("20240301100500", "bc")], [("20240301101000", "bc"), ("20240301101500", "")],
             [("20240301102500", "a"), ("20240301102000", None), ("20240301100200", "z")]]
    store = str(tmp_path / "store")
    for batch in steps:
        for stamp, users in batch:
            capture(tmp_path / "in", stamp, "Cannot connect to license server\n" if users is None else lmstat(users))
        watch.watch_checkouts(stream_dumps(spark, str(tmp_path / "in")), store, every=None).awaitTermination()
    seen = watch.CheckoutWatch(store)
    got = sorted((r.username, r.change, r.seen_at.strftime("%H%M")) for r in seen.changes(spark).collect())
    assert got == sorted([("a", "present", "1000"), ("b", "present", "1000"), ("a", "left", "1005"), ("c", "appeared", "1005"),
                          ("b", "left", "1015"), ("c", "left", "1015"), ("a", "appeared", "1025")])
    assert [r.at.strftime("%H%M") for r in seen.late(spark).collect()] == ["1002"]
    again = read_dumps(spark, str(tmp_path / "in")).where("captured_at > timestamp'2024-03-01 10:16:00'")
    seen(again, 2)
    assert seen.changes(spark).count() == 7


USAGE = "server_hostname string, feature_name string, date date, time string, users_count int"


def hourly(name, level, hours, skip=()):
    rows = []
    for h in range(hours):
        at = BEGIN + timedelta(hours=h)
        if h not in skip:
            rows.append(("s", name, at.date(), at.strftime("%H:%M:00"), level(h)))
    return rows


def test_cycles(spark):
    rng = random.Random(6)
    weeks = 24 * 7 * 5
    office = lambda h: 10 + 8 * (8 <= h % 24 <= 17)
    rows = hourly("daily", office, weeks) + hourly("weekly", lambda h: 20 if (h // 24) % 7 == 2 else 1, weeks)
    rows += hourly("flat", lambda h: 4, weeks) + hourly("noise", lambda h: rng.randrange(50), weeks)
    rows += hourly("gaps", office, weeks, skip={h for h in range(weeks) if rng.random() < 0.6})
    rows += hourly("short", office, 30) + [("s", "one", BEGIN.date(), "00:00:00", 3), ("s", "none", None, "00:00:00", 3)]
    got = {r.feature_name: r for r in cycles.cycles(spark.createDataFrame(rows, USAGE)).collect()}
    flags = {n: (r.has_daily_cycle, r.has_weekly_cycle) for n, r in got.items()}
    assert flags == {"daily": (True, True), "weekly": (False, True), "flat": (False, False), "noise": (False, False),
                     "gaps": (True, True), "short": (False, False), "one": (False, False)}
    assert got["weekly"].weekly_correlation > got["weekly"].daily_correlation + 0.1
    assert got["flat"].daily_correlation is None and got["one"].daily_pairs == 0
    # The same as from the definition, with gaps.
    levels_ = {h: r[4] for h, r in ((int((datetime.combine(r[2], datetime.min.time()) - BEGIN).days) * 24 + int(r[3][:2]), r)
                                    for r in rows if r[1] == "gaps")}
    mean = sum(levels_.values()) / len(levels_)
    var = sum((x - mean) ** 2 for x in levels_.values()) / len(levels_)
    pairs = [(x, levels_[h + 24]) for h, x in levels_.items() if h + 24 in levels_]
    assert got["gaps"].daily_pairs == len(pairs)
    assert got["gaps"].daily_correlation == pytest.approx(sum((x - mean) * (y - mean) for x, y in pairs) / len(pairs) / var)
    plan = plan_of(cycles.cycles(spark.createDataFrame(rows, USAGE)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_patterns(spark):
    rows = hourly("a", lambda h: h % 24, 24 * 14) + hourly("b", lambda h: 5, 3)
    got = {r.feature_name: r for r in cycles.seasonal_patterns(spark.createDataFrame(rows, USAGE)).collect()}
    assert got["a"].hourly_pattern == [float(h) for h in range(24)] and got["a"].daily_pattern == [11.5] * 7
    assert got["b"].hourly_pattern[:4] == [5.0, 5.0, 5.0, None] and got["b"].daily_pattern.count(None) == 6


def test_peak_periods(spark):
    day = lambda h: ((BEGIN + timedelta(hours=h)).weekday() + 1) % 7
    weeks = 24 * 7 * 2
    rows = hourly("office", lambda h: 20 if 8 <= h % 24 <= 17 and 1 <= day(h) <= 5 else 1, weeks)
    # From Saturday 22 over the end of the week to Sunday 2, and Wednesday 23 to Thursday 0.
    rows += hourly("night", lambda h: 9 if (day(h), h % 24) in {(6, 22), (6, 23), (0, 0), (0, 1), (0, 2), (3, 23), (4, 0)} else 1,
                   weeks)
    rows += hourly("flat", lambda h: 3, weeks) + hourly("nothing", lambda h: 0, weeks)
    got = {}
    for r in cycles.peak_periods(spark.createDataFrame(rows, USAGE)).collect():
        got.setdefault(r.feature_name, set()).add((r.start_hour, r.end_hour, r.hours, tuple(r.days_of_week), r.avg_usage, r.label))
    assert got == {"office": {(8, 17, 10, (1, 2, 3, 4, 5), 20.0, "Business Hours")},
                   "night": {(22, 2, 5, (6,), 9.0, "Night Peak"), (23, 0, 2, (3,), 9.0, "Night Peak")}}


def test_running_sums_and_neighbours_over_days(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), BEGIN + timedelta(hours=rng.randrange(400)), i, rng.randrange(-5, 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i long, v long")
    out = ranges.running(df, ["k"], "at", ["i"], {"total": F.col("v")})
    out = ranges.previous(out, ["k"], "at", ["i"], F.struct("i"), "before")
    out = ranges.following(out, ["k"], "at", ["i"], F.struct("i"), "after", span="month")
    for r in out.collect():
        own = sorted((t, i, v) for k, t, i, v in rows if k == r.k)
        place = next(n for n, x in enumerate(own) if x[1] == r.i)
        assert r.total == sum(v for *_, v in own[:place + 1])
        assert (r.before and r.before.i) == (own[place - 1][1] if place else None)
        assert (r.after and r.after.i) == (own[place + 1][1] if place + 1 < len(own) else None)
