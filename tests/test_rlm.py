"""Extraction of RLM texts."""

from collections import defaultdict
from datetime import datetime

import pytest

from seatmeter.operators import extract, rlm

HOST = "lic.example.org"
CAPTURED = datetime(2023, 7, 9, 8, 30)
HEAD = "rlm status on lic.example.org (port 5053, pid 77)\n\n  rlm software version v15.2 (build 1)\n\nacme 5053 Yes 77\n"

TEXTS = {
    "checkouts": HEAD + "ray v20160712 license pool status\n\tcount: 10, inuse: 2, exp: 31-Dec-2025\n"
    "ray v20160712: ann@ws-1 1/0 at 12/01 09:15 (handle: 971)\nray v20160712: bob@ws-2 1/0 at 12/01 10:30 (handle: 9)\n"
    "may v2023 license pool status\nUNCOUNTED, inuse: 1, exp: permanent\nmay v2023: cy@lib 1/0 at 07/06 13:27 (handle: 4)\n",
    "none": HEAD + "ray v1.0 license pool status\ncount: 4, inuse: 0, exp: permanent\n",
    "tools": HEAD + "rlmutil v15.2 license pool status\ncount: 5, inuse: 2, exp: permanent\n"
    "ray v1.0 license pool status\ncount: 10, inuse: 3, exp: 31-Dec-2025\n",
    "headers": HEAD + "a v20160712 license pool status (issued: 31-Dec-2025)\ncount: 1, inuse: 1, exp: permanent\n"
    "b v2024 floating license pool\ncount: 5, inuse: 2, exp: permanent\n"
    "c v13.2 license pool status\ncount: 20, inuse: 8, exp: 15-Jun-2026\n",
    "last_wins": HEAD + "a v1.0 pool\ncount: 1, inuse: 1, exp: permanent\nother 5054 Yes 78\na v2.0 pool\nUNCOUNTED, inuse: 4\n",
    "vendor_down": HEAD + "other 5054 No 0\n",
    "count_alone": "count: 5, inuse: 2, exp: permanent\n",
    "bad_times": HEAD + "a v1: u@h 1/0 at 13/01 09:15 (x)\na v1: v@h 1/0 at 1/1 09:15 (x)\na v1: w@h 1/0 at 02/29 09:15 (x)\n",
    "silent": "connection refused\n",
}


@pytest.fixture(scope="module")
def dumps(spark):
    rows = [(name, HOST, "rlm", CAPTURED, text) for name, text in TEXTS.items()]
    return spark.createDataFrame(rows, "dump_id string, host string, server_type string, captured_at timestamp, text string")


@pytest.fixture(scope="module")
def features(dumps):
    found = defaultdict(dict)
    for row in rlm.rlm_features(dumps).collect():
        found[row.dump_id][row.name] = (row.version, row.vendor_daemon, row.total_licenses, row.used_licenses,
                                        row.expiration_date.date().isoformat())
    return found


@pytest.mark.parametrize("name, expected", [
    ("checkouts", {"ray": ("v20160712", "acme", 10, 2, "2025-12-31"), "may": ("v2023", "acme", 999, 1, "2099-01-01")}),
    ("none", {"ray": ("v1.0", "acme", 4, 0, "2099-01-01")}),
    ("tools", {"ray": ("v1.0", "acme", 10, 3, "2025-12-31")}),
    ("headers", {"a": ("v20160712", "acme", 1, 1, "2099-01-01"), "b": ("v2024", "acme", 5, 2, "2099-01-01"),
                 "c": ("v13.2", "acme", 20, 8, "2026-06-15")}),
    ("last_wins", {"a": ("v2.0", "other", 999, 4, "2099-01-01")}),
    ("count_alone", {}), ("silent", {}),
])
def test_features(features, name, expected):
    assert features.get(name, {}) == expected


def test_checkouts(dumps):
    found = {(r.dump_id, r.username): r for r in rlm.rlm_checkouts(dumps).collect()}
    assert set(found) == {("checkouts", "ann"), ("checkouts", "bob"), ("checkouts", "cy"), ("bad_times", "w")}
    ann, cy = found["checkouts", "ann"], found["checkouts", "cy"]
    assert (ann.feature_name, ann.host, ann.version, ann.license_version) == ("ray", "ws-1", "v20160712", "v20160712")
    assert (ann.checked_out_at, cy.checked_out_at) == (datetime(2023, 12, 1, 9, 15), datetime(2023, 7, 6, 13, 27))
    # 2023 has no 29 February.
    assert found["bad_times", "w"].checked_out_at == datetime(2023, 3, 1, 9, 15)


def test_status(dumps):
    found = {r.dump_id: r for r in rlm.rlm_status(dumps).collect()}
    up, warned, silent = found["none"], found["vendor_down"], found["silent"]
    assert (up.service, up.master, up.version, up.message) == ("up", HOST, "15.2", "")
    assert (warned.service, warned.message) == ("warning", f"ISV other appears to be down on {HOST}")
    assert (silent.service, silent.master, silent.message) == ("down", "", "")
    assert set(found) == set(TEXTS)


def test_type_dispatch(spark, dumps):
    odd = spark.createDataFrame([("x", HOST, "spm", CAPTURED, "text")], dumps.schema)
    both = dumps.unionByName(odd)
    assert extract.all_features(both).count() == rlm.rlm_features(dumps).count()
    assert [r.reason for r in extract.unsupported(both).collect()] == ["unsupported server type: spm"]


def test_each_line_is_classified_once(dumps):
    plan = rlm.read_lines(dumps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rlm status on") == 1 and plan.count("regexp_replace") == 1
