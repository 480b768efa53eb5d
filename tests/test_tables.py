"""Inventory, alerts, checkouts, boards, retention, paging, exports."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seatmeter.operators import alerts, board, checkouts, inventory, paging, profile, retention
from seatmeter.plans import reports
from seatmeter.schemas import (
    ALERT_EVENTS, ALERTS, CHECKOUTS, FEATURE_USAGE, FEATURES, LICENSE_EVENTS, SERVER_STATUS, SERVERS,
)
from seatmeter.sinks import export
from seatmeter.sources import tables

T0 = datetime(2024, 3, 1)
NOW = datetime(2024, 3, 31, 12)


def pool(id, host="h1", name="cad", version="1", total=10, used=5, expires=None, seen=T0, active=True, vendor="v"):
    return (id, host, name, version, vendor, total, used, expires, seen, active)


def inv(spark, *rows):
    return spark.createDataFrame(list(rows), FEATURES)


def flags(df):
    return {(r.server_hostname, r.name, r.version): (r.is_active, r.used_licenses) for r in df.collect()}


def test_refresh(spark):
    current = inv(spark, pool(1), pool(2, name="mesh"), pool(3, host="h2"))
    batch = inv(spark, pool(10, used=7, seen=T0 + timedelta(minutes=5)), pool(11, version="2", seen=T0 + timedelta(minutes=5)))
    once = inventory.refresh_inventory(current, batch)
    expected = {("h1", "cad", "1"): (True, 7), ("h1", "cad", "2"): (True, 5), ("h1", "mesh", "1"): (False, 5),
                ("h2", "cad", "1"): (True, 5)}
    assert flags(once) == expected
    assert flags(inventory.refresh_inventory(once, batch)) == expected
    assert flags(inventory.refresh_inventory(current, batch.where("false"))) == flags(current)


def test_refresh_with_several_polls(spark):
    batch = inv(spark, pool(10, name="gone", seen=T0), pool(11, seen=T0), pool(12, used=1, seen=T0 + timedelta(minutes=5)))
    assert flags(inventory.refresh_inventory(inv(spark).where("false") if False else batch.where("false"), batch)) == {
        ("h1", "gone", "1"): (False, 5), ("h1", "cad", "1"): (True, 1)}


def test_null_expiry_is_one_key(spark):
    merged = inventory.refresh_inventory(inv(spark, pool(1)), inv(spark, pool(2, used=6)))
    assert [(r.id, r.used_licenses) for r in merged.collect()] == [(2, 6)]


def test_current_keeps_ties_and_inactive(spark):
    later = T0 + timedelta(hours=1)
    rows = inventory.current_utilization(inv(
        spark, pool(1, seen=T0), pool(2, version="2", seen=later, used=12, active=False),
        pool(3, version="3", seen=later), pool(4, version="4", total=0, seen=later + timedelta(hours=1)))).collect()
    assert [(r.version, r.available_licenses, r.utilization_pct) for r in rows] == [("2", -2, 120.0), ("3", 5, 50.0)]


def test_current_limits_before_shuffle(spark):
    plan = inventory.current_utilization(inv(spark, pool(1)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_duplicates_and_flag(spark):
    day = datetime(2025, 1, 1)
    rows = inv(spark, pool(1, expires=day), pool(2, expires=day + timedelta(days=1)), pool(3), pool(4))
    assert sorted(r.id for r in inventory.drop_duplicate_features(rows).collect()) == [2, 3, 4]
    old = inventory.with_active_flag(rows.drop("is_active"))
    assert {r.is_active for r in old.collect()} == {True}
    assert {r.is_active for r in inventory.with_active_flag(inv(spark, pool(1, active=None))).collect()} == {True}


def expiring(spark):
    return inv(
        spark, pool(1, name="b", expires=NOW + timedelta(days=3, hours=1)), pool(2, name="a", expires=NOW + timedelta(days=7)),
        pool(3, name="c", expires=NOW), pool(4, name="d", expires=NOW + timedelta(days=10)),
        pool(5, name="e", expires=NOW + timedelta(days=10, seconds=1)), pool(6, host="h2", expires=NOW + timedelta(days=1)),
        pool(7, host="h3", expires=NOW + timedelta(days=1), active=False))


def test_expiring(spark):
    rows = inventory.expiring_features(expiring(spark), NOW, 10).collect()
    assert [(r.id, r.days_to_expire, r.severity) for r in rows] == [
        (6, 1, "critical"), (1, 3, "critical"), (2, 7, "warning"), (4, 10, "info")]
    assert rows[1].message == "License 'b' on h1 expires in 3 days (2024-04-03)"


def test_throttle(spark):
    features = expiring(spark)

    def run(events, interval):
        log = spark.createDataFrame(events, ALERT_EVENTS)
        return sorted(r.feature_name + r.server_hostname for r in alerts.expiry_alerts(
            features, log, NOW, 10, interval).collect())

    old, fresh = NOW - timedelta(minutes=60), NOW - timedelta(minutes=59)
    assert run([(1, old, "expiration", "h1")], 60) == ["bh1", "cadh2"]
    assert run([(1, fresh, "expiration", "h1")], 60) == ["cadh2"]
    assert run([(1, fresh, "down", "h1")], 60) == ["bh1", "cadh2"]
    assert run([(1, fresh, "expiration", "h1")], 0) == ["ah1", "bh1", "cadh2", "dh1"]
    again = alerts.throttle_events(alerts.expiry_alerts(features, spark.createDataFrame([], ALERT_EVENTS), NOW))
    assert alerts.expiry_alerts(features, again, NOW + timedelta(minutes=1)).count() == 0


def queue(spark):
    return spark.createDataFrame([
        (1, "h1", "cad", "expiration", "m1", "critical", False, None, NOW - timedelta(days=2)),
        (2, "h1", "cad", "expiration", "m2", "info", True, NOW, NOW - timedelta(days=40)),
        (3, "h2", "cad", "expiration", "m3", "info", False, None, NOW - timedelta(days=3))], ALERTS)


def test_alert_queue(spark):
    rows = queue(spark)
    assert [r.id for r in alerts.unsent_alerts(rows).collect()] == [3, 1]
    assert [(r.id, r.delivery_status) for r in alerts.recent_alerts(rows, NOW).collect()] == [(1, "Pending"), (3, "Pending")]
    sent = {r.id: (r.sent, r.sent_at) for r in alerts.mark_sent(rows, rows.where("id = 1"), NOW).collect()}
    assert sent == {1: (True, NOW), 2: (True, NOW), 3: (False, None)}
    mails = {r.id: r for r in alerts.alert_messages(rows, ["a@x"], ["b@x"]).collect()}
    assert (mails[1].recipients, mails[3].recipients) == (["a@x", "b@x"], ["a@x"])
    assert mails[1].subject == "[critical] License Alert: expiration"
    assert "Time: 2024-03-29T12:00:00Z\n\nMessage:\nm1" in mails[1].body
    grown = alerts.append_alerts(rows, rows.where("id = 2").unionByName(rows.where("id = 3"))).collect()
    assert len({r.id for r in grown}) == 5 and sum(not r.sent for r in grown) == 4


def test_checkouts(spark):
    features = inv(spark, pool(1, version="1", expires=T0), pool(2, version="1"), pool(3, version="2"))
    held = spark.createDataFrame([
        ("h1", "cad", "ann", "ws", NOW - timedelta(hours=5), "9", "1"),
        ("h1", "CAD", "bob", None, None, "9", "1"), ("h1", "cad", "cy", "ws", NOW, "9", "1")], CHECKOUTS)
    assert {r.id: r.checkout_count for r in checkouts.checkout_counts(features, held).collect()} == {1: 2, 2: 2, 3: 0}
    assert sorted(r.id for r in checkouts.checked_out_only(features, held).collect()) == [1, 2]
    detail = {r.username: r for r in checkouts.checkout_detail(held, NOW, "h1", "Cad").collect()}
    assert (detail["ann"].age, detail["bob"].age, detail["bob"].host) == ("5h 0m", "-", "-")
    assert checkouts.pool_checkouts(features, held, NOW).count() == 4


def test_boards(spark):
    servers = spark.createDataFrame([
        (1, "h1", "", "flexlm", "", "", T0, T0), (2, "h2", "", "rlm", "", "", T0, T0), (3, "h3", "", "rlm", "", "", T0, T0)], SERVERS)
    status = spark.createDataFrame([("h1", "up", "m", "1.2", "", NOW)], SERVER_STATUS)
    found = {r.hostname: (r.service, r.server_version, r.message) for r in board.status_board(servers, status).collect()}
    assert found == {"h1": ("up", "1.2", ""), "h2": ("down", "", board.UNREACHABLE), "h3": ("down", "", board.UNREACHABLE)}
    types = [(r.server_type, r.servers, round(r.percentage, 1)) for r in board.server_type_distribution(servers).collect()]
    assert types == [("rlm", 2, 66.7), ("flexlm", 1, 33.3)]
    features = inv(spark, pool(1, total=10), pool(2, host="h2", total=7, active=False))
    parts = reports.dashboard(servers, features, queue(spark))
    assert parts["totals"].first().asDict() == {
        "total_servers": 3, "total_features": 1, "total_licenses": 10, "active_alerts": 2}
    live = inv(spark, pool(9, host="h2"))
    both = {(r.server_hostname, r.origin) for r in board.live_or_stored(live, features).collect()}
    assert both == {("h2", "live"), ("h1", "stored")}
    typed = board.with_server_type(inv(spark, pool(1), pool(2, host="h9")), servers)
    assert {r.server_hostname: r.server_type for r in typed.collect()} == {"h1": "flexlm", "h9": "flexlm"}
    empty = board.overview_tiles(inventory.current_utilization(features.where("false"))).first()
    assert (empty.total_features, empty.avg_utilization_pct, empty.total_licenses) == (0, 0.0, 0)


def test_retention(spark):
    day = NOW.date()
    samples = spark.createDataFrame(
        [(i, "h1", "cad", day - timedelta(days=back), "09:00:00", 1) for i, back in enumerate([0, 10, 100])], FEATURE_USAGE)
    events = spark.createDataFrame([(1, day, "09:00:00", "OUT", "cad", "u", "")], LICENSE_EVENTS)
    row = retention.retention_stats(samples, events, queue(spark), NOW).first()
    assert (row.usage_records_total, row.usage_records_30_days, row.usage_records_90_days) == (3, 2, 2)
    assert (row.events_total, row.alerts_total, row.alerts_sent) == (1, 3, 1)
    assert (row.potential_savings_rows, row.potential_savings_human) == (1, "100 B")
    assert retention.cleaned(samples, "feature_usage", NOW, 10).count() == 1, "the cutoff's own day goes"
    assert retention.cleaned(queue(spark), "alerts", NOW, 1).count() == 2, "only sent alerts go"
    with pytest.raises(ValueError):
        retention.expired("servers", NOW, 1)
    stats = {r.table_name: r for r in retention.with_row_share(retention.table_stats(
        {"feature_usage": samples, "license_events": events})).collect()}
    assert stats["feature_usage"].oldest_record == day - timedelta(days=100)
    assert stats["license_events"].row_share_pct == pytest.approx(100 / 3)
    gone = inv(spark, *[pool(i, version=str(i), active=False) for i in range(3)])
    advice = reports.storage_report({"features": gone, "feature_usage": samples})["advice"]
    assert advice.count() == 0
    told = retention.storage_advice(retention.table_stats({"features": gone}), gone, many_inactive=2).collect()
    assert [r.title for r in told] == ["Inactive Features"]


def test_paging(spark):
    rows = spark.createDataFrame([(f"h{i:03d}", "Feat" if i % 2 else "other", i) for i in range(120)],
                                 "server_hostname string, feature_name string, n int")
    assert paging.page_bounds() == (50, 0) and paging.page_bounds(limit=900, page=3) == (500, 1000)
    assert paging.page_bounds(limit=10, offset=25, page=9) == (10, 25) and paging.page_bounds(limit=-1, page=0) == (50, 0)
    ordered = paging.sorted_by(rows, "n", descending=True)
    assert [r.n for r in paging.page_of(ordered, 3, 118).collect()] == [1, 0]
    info = paging.page_info(rows, 50, 50).first()
    assert (info.total, info.page, info.total_pages, info.has_next, info.has_prev) == (120, 2, 3, True, True)
    assert paging.search(rows, "FEAT").count() == 60 and paging.search(rows, "").count() == 120
    assert paging.search(rows, "h00").count() == 10
    assert paging.sorted_by(rows, "feature_name", ties=("n",)).first().feature_name == "Feat"


def test_profiles(spark):
    sunday = date(2024, 3, 3)
    samples = spark.createDataFrame(
        [(0, "h", "cad", sunday, "09:00:00", 2), (0, "h", "cad", sunday + timedelta(days=1), "09:30:00", 6)], FEATURE_USAGE)
    assert {(r.day_of_week, r.hour, r.avg_usage) for r in profile.weekly_profile(samples).collect()} == {(0, 9, 2.0), (1, 9, 6.0)}
    row = profile.weekday_weekend(samples).first()
    assert (row.weekday_avg, row.weekend_avg) == (6.0, 2.0)
    changes = profile.feature_changes(inv(spark, pool(1), pool(2, name="x"), pool(3, name="same")),
                                      inv(spark, pool(4, used=6), pool(5, name="y"), pool(6, name="same")))
    assert {(r.name, r.change) for r in changes.collect()} == {("cad", "changed"), ("x", "removed"), ("y", "added")}


def test_exports(spark, tmp_path):
    features = inv(spark, pool(1, total=3, used=5, expires=datetime(2025, 5, 6)), pool(2, name="n, \"q\"", expires=None))
    folder = export.write_csv(export.features_layout(features), str(tmp_path / "csv"))
    back = export.read_csv_text(spark, folder, export.features_layout(features).columns)
    rows = {r["Feature"]: r for r in back.collect()}
    assert (rows["cad"]["Available"], rows["cad"]["Expiration Date"]) == ("0", "2025-05-06")
    assert rows["cad"]["Last Updated"] == "2024-03-01T00:00:00Z" and "n, \"q\"" in rows
    export.write_json(features, str(tmp_path / "json"), NOW, server="h1", days=30)
    about = spark.read.json(str(tmp_path / "json" / "about")).first()
    assert (about["count"], about["exported_at"], about["server"]) == (2, "2024-03-31T12:00:00Z", "h1")
    servers = spark.createDataFrame([(1, "h1", "", "rlm", "", "", T0, T0)], SERVERS)
    samples = spark.createDataFrame([(1, "h1", "cad", NOW.date(), "09:00:00", 3)], FEATURE_USAGE)
    report = export.combined_report(servers, features, samples, NOW)
    assert report["summary"].first().total_features == 2
    export.write_report_csv(report, str(tmp_path / "report"))
    export.write_report_json(report, str(tmp_path / "report_json"))
    lines = spark.read.option("header", True).csv(str(tmp_path / "report" / "statistics")).collect()
    assert [r.asDict() for r in lines] == [{"Server": "h1", "Feature": "cad", "Avg Usage": "3.00", "Peak Usage": "3",
                                            "Min Usage": "3", "Total Licenses": "3"}]
    assert spark.read.json(str(tmp_path / "report_json" / "heatmap")).select(F.size("hourly_data")).first()[0] == 24


def test_stored_tables(spark, tmp_path):
    samples = spark.createDataFrame([(i, "h1", "cad", date(2024, 3, 1 + i), "09:00:00", i) for i in range(5)], FEATURE_USAGE)
    tables.write_usage(samples, str(tmp_path))
    back = tables.read_table(spark, str(tmp_path), "feature_usage")
    recent = back.where(F.col("date") >= F.lit(date(2024, 3, 4)))
    assert recent.count() == 2
    assert "PartitionFilters: [isnotnull(date" in recent._jdf.queryExecution().executedPlan().toString()
    options = tables.jdbc_options("jdbc:postgresql://db/x", "feature_usage", 8, 1, 1000)
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "8")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:sqlite:x", "other")
    spark.createDataFrame([(1, "h1", "", " RLM ", "", "", T0, T0)], SERVERS).write.json(str(tmp_path / "servers.json"))
    assert tables.read_servers(spark, str(tmp_path / "servers.json")).first().type == "rlm"
