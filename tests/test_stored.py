"""Stored tables: pages found through a directory, cleanup by day, counts from footers, bundles of captures."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seatmeter.operators import paging, retention
from seatmeter.sources import dumps, tables

AS_OF = datetime(2024, 3, 31, 12)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = "name string, n int, x double, day date, id long"


@pytest.fixture(scope="module")
def rows():
    """Names of which one has a third of all rows, some equal in their first bytes; nulls everywhere."""
    rng = random.Random(1)
    out = []
    for i in range(4000):
        name = "hot" if i % 3 == 0 else rng.choice(["", "Ünder", "under", "Under score", "samestart-a", "samestart-b", None, "z" * 40])
        out.append((name, rng.choice([None, 1, 2, 3, 10 ** 9, -5]), rng.choice([None, 0.5, -1e300, 2.0, float("inf")]),
                    rng.choice([None, date(2024, 1, 1), date(1969, 5, 5)]), i))
    return out


def place(value, down, first):
    """Nulls come first, or last in a falling order."""
    if value is None:
        return (1 if down else 0,)
    if isinstance(value, str):
        value = tuple((255 - b if down else b) for b in (value.lower() if first else value).encode()) + ((256,) if down else (-1,))
    elif isinstance(value, date):
        value = -value.toordinal() if down else value.toordinal()
    else:
        value = -value if down else value
    return (0 if down else 1, value)


@pytest.mark.parametrize("order,fold", [
    ([("name", False), ("id", False)], True), ([("name", True), ("id", True)], False), ([("n", True), ("id", False)], False),
    ([("x", False), ("n", True), ("id", False)], False), ([("day", True), ("name", False), ("id", False)], False)])
def test_pages_of_a_directory(spark, rows, order, fold):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    directory = paging.PageDirectory(df, order, ranges=16, fold=fold)
    fields = {c.split()[0]: k for k, c in enumerate(ROWS.split(", "))}
    want = sorted(rows, key=lambda r: [place(r[fields[c]], down, fold and not k) for k, (c, down) in enumerate(order)])
    assert directory.total == len(rows)
    for limit, offset in ((25, 0), (25, 990), (40, 2000), (300, 3100), (25, 3990), (10, 4000), (10, 9999)):
        got = [r.id for r in directory.page(limit, offset).collect()]
        assert got == [r[4] for r in want[offset:offset + limit]]


def test_a_deep_page_sorts_one_range(spark, tmp_path):
    spark.range(20_000).select("id", (F.col("id") * 7919 % 20_011).alias("n")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    directory = paging.PageDirectory(table, [("n", False), ("id", False)], ranges=100)
    page = directory.page(20, 15_000)
    optimized = page._jdf.queryExecution().optimizedPlan().toString()
    skipped = int(optimized.split("Offset ")[1].split()[0])
    assert skipped < 1000
    # What is sorted is what the filter leaves: one range, not the table.
    low, high = next((low, high) for before, (count, low, high, _) in zip(
        [sum(c[0] for c in directory.counts[:k]) for k in range(len(directory.counts))], directory.counts) if before <= 15_000 < before + count)
    assert table.where(F.col("n").between(low, high)).count() < 1000
    assert [r.n for r in page.collect()] == [r.n for r in table.orderBy("n").offset(15_000).limit(20).collect()]


def test_empty_directory(spark):
    none = paging.PageDirectory(spark.createDataFrame([], ROWS), [("name", False)])
    assert none.total == 0 and none.page(10, 0).count() == 0


ALERT_ROWS = ("id bigint, server_hostname string, feature_name string, alert_type string, message string, severity string, "
              "sent boolean, sent_at timestamp, created_at timestamp")


def files(folder):
    return {os.path.relpath(os.path.join(at, name), folder): os.stat(os.path.join(at, name)).st_mtime_ns
            for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}


def test_cleanup_touches_old_days_only(spark, tmp_path):
    """Sent alerts go by their moment; days keep their files unless they lose a row."""
    rows = [(i, "h", "f", "t", "m", "info", i % 4 != 0, None, AS_OF - timedelta(hours=7 * i)) for i in range(60)]
    rows += [(100, "h", "f", "t", "m", "info", True, None, AS_OF - timedelta(days=40)),
             (101, "h", "f", "t", "m", "info", False, None, AS_OF - timedelta(days=45)), (102, "h", "f", "t", "m", "info", True, None, None)]
    folder, cutoff = str(tmp_path), AS_OF - timedelta(days=10)
    tables.write_by_day(spark.createDataFrame(rows, ALERT_ROWS), folder, "alerts")
    before = files(folder)
    counts = retention.clean_stored(spark, folder, "alerts", AS_OF, 10).first()
    gone = {r[0] for r in rows if r[8] is not None and r[8] < cutoff and r[6]}
    assert (counts.rows_deleted, counts.rows_kept) == (len(gone), len(rows) - len(gone)) and len(gone) > 10
    left = {r.id: r.created_at for r in tables.read_by_day(spark, folder, "alerts").collect()}
    assert set(left) == {r[0] for r in rows} - gone
    after = files(folder)
    day = lambda path: path.split("created_on=")[1].split("/")[0]
    lost = {r[8].date().isoformat() for r in rows if r[0] in gone}
    kept = {p: t for p, t in before.items() if day(p) not in lost}
    assert kept and all(after.get(p) == t for p, t in kept.items())
    whole = {d for d in lost if all(r[0] in gone for r in rows if r[8] is not None and r[8].date().isoformat() == d)}
    assert whole and not any(os.path.exists(f"{folder}/alerts/created_on={d}") for d in whole)
    # Once more: nothing is left to do, and no file changes.
    assert retention.clean_stored(spark, folder, "alerts", AS_OF, 10).first().rows_deleted == 0 and files(folder) == after


def test_cleanup_reads_no_day_after_the_cutoff(spark, tmp_path):
    usage = spark.createDataFrame([(i, "h", "f", date(2024, 3, 1) + timedelta(days=i), "10:00:00", 1) for i in range(28)],
                                  "id long, server_hostname string, feature_name string, date date, time string, users_count int")
    tables.write_by_day(usage, str(tmp_path), "feature_usage")
    for name in ("date=2024-03-25", "date=2024-03-28"):
        for path in (tmp_path / "feature_usage" / name).glob("*.parquet"):
            path.write_bytes(b"not a table")
    with pytest.raises(Exception):
        tables.read_by_day(spark, str(tmp_path), "feature_usage").agg(F.sum("users_count")).collect()
    found = retention.clean_stored(spark, str(tmp_path), "feature_usage", AS_OF, 20)
    assert not os.path.exists(tmp_path / "feature_usage/date=2024-03-11") and os.path.exists(tmp_path / "feature_usage/date=2024-03-12")
    assert "rows_deleted" in found.columns


def test_counts_come_from_footers(spark, tmp_path):
    usage = spark.createDataFrame([(i, "h", "f", date(2024, 3, 1 + i % 5), "10:00:00", 1) for i in range(50)],
                                  "id long, server_hostname string, feature_name string, date date, time string, users_count int")
    tables.write_by_day(usage, str(tmp_path), "feature_usage")
    spark.createDataFrame([(1, datetime(2024, 3, 1), "t", "h")], "id bigint, datetime timestamp, type string, hostname string") \
        .write.parquet(str(tmp_path / "alert_events"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    found = retention.stored_table_stats(spark, str(tmp_path))
    plan = plan_of(found)
    assert plan.count("PushedAggregation: [COUNT(*)]") == 2 and "PushedGroupBy: [date]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert sorted(map(tuple, found.collect())) == [("alert_events", 1, None, None), ("feature_usage", 50, date(2024, 3, 1), date(2024, 3, 5))]
    assert retention.stored_table_stats(spark, str(tmp_path / "none")).count() == 0


def test_bundles_give_back_what_was_written(spark, tmp_path):
    texts = [("a", "27000@h", "flexlm", datetime(2024, 3, 1, 1, 2, 3, 456789), "one\ntwo\r\n\n  three"), ("b", "h", "rlm", datetime(1969, 1, 1), ""),
             ("c", None, None, None, None), ("d", "h", "flexlm", AS_OF, "\n\nstarts blank \x1d é 😀" + " x" * 50_000)]
    rows = spark.createDataFrame(texts, "dump_id string, host string, server_type string, captured_at timestamp, text string")
    dumps.write_bundles(rows.repartition(2), str(tmp_path / "b"))
    dumps.write_bundles(rows.limit(0), str(tmp_path / "b"))
    got = {r.dump_id: tuple(r) for r in dumps.read_bundles(spark, str(tmp_path / "b")).select(*rows.columns).collect()}
    assert got == {t[0]: (*t[:4], t[4] or "") for t in texts}
    stream = dumps.stream_bundles(spark, str(tmp_path / "b")).writeStream.format("memory").queryName("bundles").trigger(availableNow=True)
    stream.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert spark.table("bundles").count() == 4
