from datetime import datetime, timedelta

import numpy as np

from seatmeter.llm import urls as q

T = datetime(2024, 1, 1)
ENTRY = "entry string, category string, verdict string, at timestamp, action string"


def day(n):
    return None if n is None else T + timedelta(days=n)


def entries(spark, rows):
    return spark.createDataFrame([(e, c, v, day(d), a) for e, c, v, d, a in rows], ENTRY)


def captures(spark, rows):
    """With extra columns named like the results and inner columns."""
    return spark.createDataFrame([(i, u, day(d), "h", "v", 1, "m") for i, u, d in rows],
                                 "page_id long, url string, fetched_at timestamp, host string, _row string, month int, _hit string")


def verdicts(spark, rows, listed):
    return [tuple(r) for r in q.judged(captures(spark, rows).drop("host"), entries(spark, listed)).orderBy("page_id")
            .select("verdict", "entry", "category").collect()]


def test_validity(spark):
    listed = [("a.com", "spam", "block", 10, "list"), ("a.com", "spam", "block", 20, "list"),
              ("a.com", "spam", "block", 50, "delist"), ("a.com", "spam", "block", 90, "delist"),
              ("a.com", "spam", "block", 200, "list"), ("a.com", "spam", "block", 60, "other"),
              (None, "spam", "block", 1, "list"), ("x.com", "spam", "block", None, "list")]
    rows = [(k, "http://a.com/x", d) for k, d in enumerate((9, 10, 49.9, 50, 199, 200, 900))]
    blocked = [v[0] == "block" for v in verdicts(spark, rows, listed)]
    assert blocked == [False, True, True, False, False, True, True]
    assert q.intervals(entries(spark, listed)).count() == 2


def test_delisted_and_listed_at_once_stays_listed(spark):
    listed = [("a.com", "s", "block", 1, "list"), ("a.com", "s", "block", 5, "delist"), ("a.com", "s", "block", 5, "list")]
    assert verdicts(spark, [(1, "http://a.com", 6)], listed)[0][0] == "block"


def test_longest_entry_decides(spark):
    listed = [("a.com", "spam", "block", 0, "list"), ("ok.a.com", "reviewed", "allow", 0, "list"),
              ("a.com/forum", "adult", "block", 0, "list"), ("B.com", "s", "allow", 0, "list"), ("b.com", "t", "block", 0, "list")]
    rows = [(1, "https://x.y.a.com/", 1), (2, "https://OK.a.com:8080/forum?x", 1), (3, "http://u@www.a.com/forum/1", 1),
            (4, "http://a.company.com/", 1), (5, "http://b.com", 1)]
    assert verdicts(spark, rows, listed) == [
        ("block", "a.com", "spam"), ("block", "a.com/forum", "adult"), ("block", "a.com/forum", "adult"),
        ("none", None, None), ("block", "b.com", "t")]


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "no url", 1), (4, "http://", 1), (5, "http://a.com/", None), (None, "http://a.com", 1),
            (6, "http://a.com", 1), (6, "http://a.com", 1), (7, "http://" + "a." * 3000 + "com/" + "p" * 5000, 1)]
    listed = [("a.com", "spam", "block", 0, "list")]
    got = verdicts(spark, rows, listed)
    assert [v[0] for v in got] == ["block", "none", "none", "none", "none", "none", "block", "block", "block"]
    assert q.judged(captures(spark, rows), entries(spark, [])).where("verdict = 'none'").count() == len(rows)
    assert q.judged(captures(spark, []), entries(spark, listed)).count() == 0
    data = captures(spark, rows)
    kept = q.blocked_removed(data, entries(spark, listed))
    assert kept.columns == data.columns and kept.count() == 5


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "e.d.org"]
    listed = [(str(rng.choice(hosts)), f"c{rng.integers(3)}", str(rng.choice(["block", "allow"])), int(rng.integers(0, 800)),
               str(rng.choice(["list", "delist"]))) for _ in range(120)]
    rows = [(k, f"http://{rng.choice(hosts)}/p", float(rng.integers(0, 1600)) / 2) for k in range(400)]

    def active(entry, category, verdict, t):
        events = sorted((d, a == "list") for e, c, v, d, a in listed if (e, c, v) == (entry, category, verdict) and d <= t)
        return bool(events) and events[-1][1]

    kinds = sorted({(e, c, v) for e, c, v, _, _ in listed})
    want = []
    for _, url, t in rows:
        host = url[7:-2]
        hits = [(len(e), v == "block", v, e, c) for e, c, v in kinds
                if (host == e or host.endswith("." + e)) and active(e, c, v, t)]
        want.append((max(hits)[2], max(hits)[3], max(hits)[4]) if hits else ("none", None, None))
    assert verdicts(spark, rows, listed) == want


def test_entries_keep_the_case_of_their_path(spark):
    entries = spark.sql("select 'Example.COM/Forum' entry, 'c' category, 'block' verdict, timestamp'2024-01-01' at, 'list' action")
    captures = spark.sql("select url, timestamp'2024-02-01' fetched_at from values ('http://example.com/Forum/1'),"
                         " ('http://EXAMPLE.com/forum') as t(url)")
    got = {r.url: (r.verdict, r.entry) for r in q.judged(captures, entries).collect()}
    assert got == {"http://example.com/Forum/1": ("block", "example.com/Forum"), "http://EXAMPLE.com/forum": ("none", None)}
