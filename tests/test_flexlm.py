"""Extraction of FlexLM texts: one text per trait, all read in one job."""

from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seatmeter.operators import flexlm
from seatmeter.operators.dump_lines import lowered

HOST = "27000@lic.example.org"
CAPTURED = datetime(2024, 3, 9, 8, 30)
UP = "    lic.example.org: license server UP (MASTER) v11.19.2\n"


def usage(name, total, used):
    plural = "" if used == 1 else "s"
    return f"Users of {name}:  (Total of {total} licenses issued;  Total of {used} license{plural} in use)\n"


def holder(user, start, version="(v2024.1)", fields="ws-1 /dev/pts"):
    return f"    {user} {fields} {version} (lic/27000 17), start {start}\n"


TEXTS = {
    "permanent": UP + usage("cad", 10, 5) + "cad 1.0 10 acme permanent\n",
    "old_dates": UP + "mesh 2.0 5 31-dec-2025 acme\nview 3.0 3 15-jan-2024\n",
    "new_date": UP + "solve 4.0 8 acme 20-jun-2026\n",
    "upper_case": UP + "USERS OF draw: (TOTAL OF 7 LICENSES ISSUED; TOTAL OF 2 LICENSES IN USE)\n",
    "no_such": UP + usage("gone", 4, 1) + "gone 1.0 4 acme permanent\nNo such feature exists.\n" + usage("kept", 6, 2)
    + "kept 1.0 6 acme permanent\n",
    "no_such_twice": usage("kept", 6, 2) + usage("gone", 4, 1) + "no such feature exists\nno such feature exists\n",
    "named_again": usage("back", 4, 1) + "No such feature exists\n" + usage("back", 9, 3),
    "zero_years": UP + "a 1.0 5 acme 1-jan-0000\nb 1.0 5 acme 1-jan-0\n",
    "uncounted": UP + "Users of free: (uncounted, node-locked)\n" + holder("ann", "Fri 3/8 9:05"),
    "versions": UP + usage("cad", 15, 5) + '  "cad" v2023.1, vendor: acme\n' + holder("ann", "Fri 3/8 9:05")
    + holder("bob", "Fri 3/8 10:15") + holder("cy", "Sat 3/9 8:00", "(v2024.0)")
    + "cad 2023.1 10 acme 31-dec-2025\ncad 2024.0 5 acme 30-jun-2026\n",
    "no_v": usage("cad", 5, 1) + holder("ann", "Fri 3/8 9:05", "(2023.1)"),
    "years": usage("cad", 5, 5) + holder("a", "Mon 1/2/24 9:00") + holder("b", "Mon 1/2/2023 9:00")
    + holder("c", "Mon 1/2 9:00") + holder("d", "Mon 1/2/98 9:00") + holder("e", "Monday 1/2 9:00")
    + holder("f", "Mon 13/2 9:00") + holder("g", "Mon 2/30 9:00"),
    "four_fields": usage("pre", 12, 1) + '  "pre" v2026.0630, vendor: acme, expiry: permanent(no expiration date)\n'
    + holder("dan.ro", "Thu 1/29 11:39", "(v2025.0506)", "pc19.example.org pc19.example.org 3068"),
    "same_pool": usage("act", 25, 2) + '  "act" v2026.0630, vendor: acme\n' + holder("a", "Thu 1/29 11:39")
    + holder("b", "Thu 1/29 12:00") + "act 2026.0630 10 acme permanent\nact 2026.0630 15 acme permanent\n",
    "two_expiries": "cad 1.0 10 acme 31-dec-2025\ncad 1.0 15 acme 30-jun-2026\n",
    "proportional": usage("cad", 100, 50) + "cad 1.0 60 acme permanent\ncad 2.0 40 acme permanent\n",
    "over_proportional": usage("cad", 10, 50) + "cad 1.0 10 acme permanent\n",
    "inline_only": usage("a", 3, 1) + '  "a" v2024.0506, vendor: acme\n' + holder("u", "Thu 1/25 11:39")
    + usage("b", 4, 2) + '  "b" v1.0, vendor: acme\n',
    "case": usage("ANS_ACT", 5, 2) + '  "ans_act" v2026.0630, vendor: acme\n' + holder("a", "Thu 1/25 11:39")
    + holder("b", "Thu 1/25 11:40") + "ans_act 2026.0630 5 acme permanent\n",
    "other_inline": usage("cad", 5, 1) + '  "other" v9.9, vendor: acme\n' + holder("a", "Thu 1/25 11:39")
    + "CAD 3.0 5 acme permanent\n",
    "version_later": usage("cad", 5, 1) + holder("a", "Thu 1/25 11:39") + '  "cad" v7.0, vendor: acme\n',
    "ambiguous": usage("cad", 5, 1) + holder("a", "Thu 1/25 11:39") + "cad 1.0 2 acme permanent\ncad 2.0 3 acme permanent\n",
    "cannot_connect": UP + usage("cad", 5, 1) + holder("a", "Thu 1/25 11:39")
    + "Cannot connect to license server system.\n" + usage("later", 5, 1),
    "cannot_read": "lmstat\nCannot read data from license server\n",
    "error_status": "Error getting status: no license\n",
    "vendor_down": UP + "acme: vendor daemon is down\n",
    "empty": "",
    "no_feature_yet": holder("a", "Thu 1/25 11:39") + UP,
    "windows_ends": (UP + usage("cad", 10, 5) + "cad 1.0 10 acme permanent\n").replace("\n", "\r\n"),
    "last_usage_wins": usage("cad", 10, 5) + usage("cad", 20, 8),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, HOST, "flexlm", CAPTURED, text) for name, text in TEXTS.items()]
    dumps = spark.createDataFrame(rows, "dump_id string, host string, server_type string, captured_at timestamp, text string")
    found = {"status": {}, "features": defaultdict(dict), "checkouts": defaultdict(dict)}
    for row in flexlm.flexlm_status(dumps).collect():
        found["status"][row.dump_id] = row
    for row in flexlm.flexlm_features(dumps).collect():
        expiry = row.expiration_date and row.expiration_date.date().isoformat()
        assert (row.name, row.version, expiry) not in found["features"][row.dump_id]
        found["features"][row.dump_id][row.name, row.version, expiry] = (
            row.vendor_daemon, row.total_licenses, row.used_licenses)
    for row in flexlm.flexlm_checkouts(dumps).collect():
        found["checkouts"][row.dump_id][row.username] = row
    return found


@pytest.mark.parametrize("name, expected", [
    ("permanent", {("cad", "1.0", "2099-01-01"): ("acme", 10, 5)}),
    ("old_dates", {("mesh", "2.0", "2025-12-31"): ("acme", 5, 0), ("view", "3.0", "2024-01-15"): ("", 3, 0)}),
    ("new_date", {("solve", "4.0", "2026-06-20"): ("acme", 8, 0)}),
    ("upper_case", {("draw", "", None): ("", 7, 2)}),
    ("no_such", {("kept", "1.0", "2099-01-01"): ("acme", 6, 2)}),
    ("no_such_twice", {("kept", "", None): ("", 6, 2)}),
    ("named_again", {("back", "", None): ("", 9, 3)}),
    ("zero_years", {("a", "1.0", "2036-01-01"): ("acme", 5, 0), ("b", "1.0", "2036-01-01"): ("acme", 5, 0)}),
    ("uncounted", {("free", "", None): ("", 9999, 1)}),
    ("versions", {("cad", "2023.1", "2025-12-31"): ("acme", 10, 3), ("cad", "2024.0", "2026-06-30"): ("acme", 5, 1)}),
    ("no_v", {("cad", "", None): ("", 5, 1)}),
    ("four_fields", {("pre", "2026.0630", None): ("", 12, 1)}),
    ("same_pool", {("act", "2026.0630", "2099-01-01"): ("acme", 25, 2)}),
    ("two_expiries", {("cad", "1.0", "2025-12-31"): ("acme", 10, 0), ("cad", "1.0", "2026-06-30"): ("acme", 15, 0)}),
    ("proportional", {("cad", "1.0", "2099-01-01"): ("acme", 60, 30), ("cad", "2.0", "2099-01-01"): ("acme", 40, 20)}),
    ("over_proportional", {("cad", "1.0", "2099-01-01"): ("acme", 10, 10)}),
    ("inline_only", {("a", "2024.0506", None): ("", 3, 1), ("b", "1.0", None): ("", 4, 2)}),
    ("case", {("ANS_ACT", "2026.0630", None): ("", 5, 2), ("ans_act", "2026.0630", "2099-01-01"): ("acme", 5, 0)}),
    ("other_inline", {("cad", "", None): ("", 5, 1), ("CAD", "3.0", "2099-01-01"): ("acme", 5, 0)}),
    ("version_later", {("cad", "7.0", None): ("", 5, 1)}),
    ("ambiguous", {("cad", "1.0", "2099-01-01"): ("acme", 2, 0), ("cad", "2.0", "2099-01-01"): ("acme", 3, 0)}),
    ("cannot_connect", {}), ("vendor_down", {}), ("empty", {}),
    ("windows_ends", {("cad", "1.0", "2099-01-01"): ("acme", 10, 5)}),
    ("last_usage_wins", {("cad", "", None): ("", 20, 8)}),
])
def test_features(results, name, expected):
    assert results["features"].get(name, {}) == expected


@pytest.mark.parametrize("name, service, message", [
    ("permanent", "up", ""), ("cannot_connect", "down", f"Cannot connect to {HOST}"),
    ("cannot_read", "down", f"Cannot read data from {HOST}"),
    ("error_status", "down", f"Error getting status from {HOST}"),
    ("vendor_down", "warning", f"Vendor daemon is down on {HOST}"),
    ("empty", "down", ""), ("two_expiries", "down", ""), ("no_feature_yet", "up", ""),
])
def test_status(results, name, service, message):
    row = results["status"][name]
    assert (row.hostname, row.service, row.message, row.last_checked) == (HOST, service, message, CAPTURED)


def test_status_details(results):
    assert set(results["status"]) == set(TEXTS)
    row = results["status"]["permanent"]
    assert (row.master, row.version) == ("lic", "11.19.2")


@pytest.mark.parametrize("name, expected", [
    ("versions", {"ann": ("2024.1", "2023.1"), "bob": ("2024.1", "2023.1"), "cy": ("2024.0", "2023.1")}),
    ("no_v", {"ann": ("2023.1", "")}),
    ("four_fields", {"dan.ro": ("2025.0506", "2026.0630")}),
    ("case", {"a": ("2024.1", "2026.0630"), "b": ("2024.1", "2026.0630")}),
    ("other_inline", {"a": ("2024.1", "3.0")}),
    ("version_later", {"a": ("2024.1", "7.0")}),
    ("ambiguous", {"a": ("2024.1", "")}),
    ("cannot_connect", {"a": ("2024.1", "")}),
    ("no_feature_yet", {}),
    ("uncounted", {"ann": ("2024.1", "")}),
])
def test_checkout_versions(results, name, expected):
    rows = results["checkouts"].get(name, {})
    assert {user: (row.version, row.license_version) for user, row in rows.items()} == expected


def test_checkout_times(results):
    rows = results["checkouts"]["years"]
    assert {user: row.checked_out_at for user, row in rows.items()} == {
        "a": datetime(2024, 1, 2, 9), "b": datetime(2023, 1, 2, 9), "c": datetime(2024, 1, 2, 9),
        "d": datetime(1998, 1, 2, 9)}
    assert rows["a"].host == "ws-1"


def test_one_shuffle(spark):
    dumps = spark.createDataFrame(
        [("1", HOST, "flexlm", CAPTURED, "x")],
        "dump_id string, host string, server_type string, captured_at timestamp, text string")
    plan = flexlm.flexlm_features(dumps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # Lines in order, features with their other cases, pools: the count over a version needs no order of its own.
    assert plan.count("Sort [") == 3


def test_lines_are_not_put_in_lower_case(spark):
    dumps = spark.createDataFrame(
        [("1", HOST, "flexlm", CAPTURED, "x")],
        "dump_id string, host string, server_type string, captured_at timestamp, text string")
    assert "lower(" not in flexlm.read_lines(dumps)._jdf.queryExecution().optimizedPlan().toString()


def test_lowered(spark):
    texts = ["cad", "CAD-1", "a{z}", "@[`", "\u0130x", "\u212a", "\u00c4\u00e4", "tab\t", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~lowered(F.col("t")).eqNullSafe(F.lower("t"))).count() == 0
