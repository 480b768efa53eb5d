"""Streaming jobs, run with availableNow over small inputs and compared with their batch counterparts."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path
from urllib.parse import quote, urlparse

import pytest
from pyspark.sql import functions as F

from seatmeter.operators import alerts as queue
from seatmeter.operators import flexlm, rlm
from seatmeter.plans import queries
from seatmeter.plans.queries import QUERIES
from seatmeter.schemas import ALERTS
from seatmeter.sources.dumps import read_dumps, stream_bundles, stream_dumps, write_bundles
from seatmeter.streaming import alerts, feed, ingest

HOST = "27000@lic.example.org"


def text(feature, used, more=""):
    return (f"    lic.example.org: license server UP v11.1.1\nUsers of {feature}:  (Total of 9 licenses issued;  "
            f"Total of {used} licenses in use)\n{feature} 1.0 9 acme permanent\n{more}")


def capture(folder, stamp, body, host=HOST, kind="flexlm"):
    path = folder / kind / host / f"{stamp}.txt"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)


def test_read_dumps(spark, tmp_path):
    capture(tmp_path, "20240301120500", text("cad", 3))
    row = read_dumps(spark, str(tmp_path)).first()
    assert (row.host, row.server_type, row.captured_at) == (HOST, "flexlm", datetime(2024, 3, 1, 12, 5))
    assert row.text.startswith("    lic") and quote(HOST) in row.dump_id or HOST in row.dump_id


def test_stored_texts_are_parsed_where_they_are_read(spark, tmp_path):
    capture(tmp_path, "20240301120500", "x v1.0: u@h 1/0 at 03/01 12:00 (handle: 1)\n", kind="rlm")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    texts = read_dumps(spark, str(tmp_path))
    assert "Exchange" not in plan(rlm.rlm_checkouts(texts))
    for extracted in (flexlm.flexlm_features(texts), flexlm.flexlm_status(texts), rlm.rlm_status(texts)):
        below = plan(extracted).split("Exchange")[-1]           # what lies under the lowest exchange
        assert "Generate posexplode" in below and "value" not in below.split("[plan_id")[0].split("Project")[0]


def test_pools_are_numbered_without_gathering_all_texts(spark):
    at = lambda hour, minute: datetime(2024, 3, 1, hour, minute)
    pools = spark.createDataFrame(
        [("b", "x", "1", None, at(9, 5)), ("b", "w", "1", None, at(9, 5)), ("a", "x", "1", None, at(9, 5)),
         ("c", "x", "1", None, at(8, 59)), ("d", "x", "1", None, None), ("e", "x", "1", None, at(23, 0))],
        "dump_id string, name string, version string, expiration_date timestamp, last_updated timestamp")
    numbered = ingest.Collector._numbered(pools, 2)
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    ids = {(r.dump_id, r.name): r.id - (2 << 32) for r in numbered.collect()}
    assert ids == {("d", "x"): 1, ("c", "x"): 2, ("a", "x"): 3, ("b", "w"): 4, ("b", "x"): 5, ("e", "x"): 6}


def test_collect(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    capture(source, "20240301120500", text("cad", 3, "mesh 1.0 4 acme permanent\n"))
    capture(source, "20240301120530", text("cad", 4, "mesh 1.0 4 acme permanent\n"))
    ingest.collect(stream_dumps(spark, str(source)), store, every=None).awaitTermination()
    collector = ingest.Collector(store)
    first = {r.name: r for r in collector.features(spark, 0).collect()}
    assert {n: (r.used_licenses, r.is_active) for n, r in first.items()} == {"cad": (4, True), "mesh": (0, True)}
    assert {(r.feature_name, r.time, r.users_count) for r in collector.usage(spark).collect()} == {
        ("cad", "12:05:00", 3), ("mesh", "12:05:00", 0)}

    capture(source, "20240302001000", text("cad", 5))
    capture(source, "20240302001001", "Cannot connect to license server\n", host="other")
    ingest.collect(stream_dumps(spark, str(source)), store, every=None).awaitTermination()
    second = {r.name: (r.used_licenses, r.is_active) for r in collector.features(spark, 1).collect()}
    assert second == {"cad": (5, True), "mesh": (0, False)}
    kept = collector.usage(spark)
    assert kept.count() == 3 and kept.where(F.col("date") == F.lit(date(2024, 3, 2))).first().users_count == 5

    # A batch that runs again replaces its own output.
    again = read_dumps(spark, str(source)).where(F.col("captured_at") >= F.lit("2024-03-02").cast("timestamp"))
    collector(again, 1)
    assert collector.usage(spark).count() == 3
    assert len({r.id for r in collector.usage(spark).collect()}) == 3


def test_collect_nothing(spark, tmp_path):
    capture(tmp_path / "in", "20240301120500", "Cannot connect to license server\n")
    ingest.collect(stream_dumps(spark, str(tmp_path / "in")), str(tmp_path / "store"), every=None).awaitTermination()
    collector = ingest.Collector(str(tmp_path / "store"))
    assert collector.features(spark, 0).count() == 0 and collector.usage(spark).count() == 0


def stream_of(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


SAMPLES = "id bigint, server_hostname string, feature_name string, date date, time string, users_count int"


def test_distinct_samples_however_late(spark, tmp_path):
    """Three files, one per micro-batch, newest first, with repeats in and across them."""
    rows = [(i, f"h{i % 3}", "cad", date(2024, 3, 1 + i // 40), f"{i % 24:02}:00:00", i) for i in range(120)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 120, 5)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[80:], rows[40:80], rows[:40], [(2000, None, None, date(2024, 3, 1), None, 1)] * 2):
        ingest.distinct_samples(stream_of(spark, part, SAMPLES, source), target, every=None).awaitTermination()
    log = ingest.SampleLog(f"{target}/samples")
    key = lambda r: (r.server_hostname or "", r.feature_name or "", r.date, r.time or "")
    got = sorted(map(key, log.rows(spark).collect()))
    assert got == sorted({(h, f, d, t) for _, h, f, d, t, _ in rows} | {("", "", date(2024, 3, 1), "")})
    # A batch that runs again replaces its own output.
    log(spark.createDataFrame(rows[40:80], SAMPLES), 1)
    assert sorted(map(key, log.rows(spark).collect())) == got
    assert [r[0] for r in log.before(spark, ["2024-03-02", "1999-01-01"], 99).select("date").distinct().collect()] == [date(2024, 3, 2)]


def test_samples_without_a_date_are_stored_once(spark, tmp_path):
    log = ingest.SampleLog(str(tmp_path / "log"))
    rows = [(1, "h", "cad", None, "10:00:00", 3), (2, None, None, None, None, 4), (3, "h", "cad", date(2024, 3, 1), "10:00:00", 5)]
    for batch in range(3):
        log(spark.createDataFrame([(r[0] + 10 * batch, *r[1:]) for r in rows], SAMPLES), batch)
    assert sorted(r.id for r in log.rows(spark).collect()) == [1, 2, 3]
    log(spark.createDataFrame([], SAMPLES), 3)
    assert log.rows(spark).count() == 3


def test_stored_days_are_listed_and_read_once(spark, tmp_path):
    log = ingest.SampleLog(str(tmp_path / "log"))
    log(spark.createDataFrame([(i, "h", "cad", date(2024, 3, 1 + i), "10:00:00", 3) for i in range(20)], SAMPLES), 0)
    plan = log.before(spark, [date(2024, 3, 1 + i) for i in range(20)], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 1 and plan.count("Union") <= 3


def test_closed_days(spark, tmp_path):
    """Days that are over become one file set; rows that come for them later are compared with it and kept."""
    log = ingest.SampleLog(str(tmp_path / "log"))
    row = lambda i, day, minute: (i, "h", "cad", date(2024, 3, day), f"10:{minute:02}:00", i)
    for batch in range(4):
        log(spark.createDataFrame([row(10 * batch + k, 1 + k, batch) for k in range(3)], SAMPLES), batch)
    before = sorted(map(tuple, log.rows(spark).collect()))
    assert log.close(spark, date(2024, 3, 3), 3) == [date(2024, 3, 1), date(2024, 3, 2)]
    assert sorted(map(tuple, log.rows(spark).collect())) == before and len(before) == 12
    assert sorted(p.name for p in (tmp_path / "log").glob("date=*/batch_id=*")) == [f"batch_id={b}" for b in range(4)]
    log(spark.createDataFrame([row(90, 1, 2), row(91, 1, 30), row(92, 3, 2)], SAMPLES), 4)
    assert sorted(r.id for r in log.rows(spark).collect()) == sorted([r[0] for r in before] + [91])
    # Closed again, also by a run that had stopped before deleting what it replaced.
    assert log.close(spark, date(2024, 3, 3), 4) == [date(2024, 3, 1)]
    assert log.rows(spark).count() == 13 and log.close(spark, date(2024, 3, 3), 4) == []
    spark.createDataFrame([row(91, 1, 30)], SAMPLES).drop("date").write.parquet(str(tmp_path / "log/date=2024-03-01/batch_id=4"))
    assert log.rows(spark).count() == 13


def test_newest_captures_first(spark, tmp_path):
    """Captures that arrive later but are older add pools; they change neither newer numbers nor what is active."""
    source, store = tmp_path / "in", str(tmp_path / "store")
    for batch, (stamp, used, more) in enumerate([
            ("20240302120000", 5, ""), ("20240301120000", 3, "mesh 1.0 4 acme permanent\n"), ("20240303120000", 7, "mesh 1.0 4 acme permanent\n"),
            ("20240302180000", 1, "old 1.0 2 acme permanent\n")]):
        capture(source, stamp, text("cad", used, more))
        ingest.collect(stream_dumps(spark, str(source)), store, every=None).awaitTermination()
        rows = {r.name: (r.used_licenses, r.is_active) for r in ingest.Collector(store).features(spark, batch).collect()}
        assert rows == [{"cad": (5, True)}, {"cad": (5, True), "mesh": (0, False)}, {"cad": (7, True), "mesh": (0, True)},
                        {"cad": (7, True), "mesh": (0, True), "old": (0, False)}][batch]
    assert ingest.Collector(store).usage(spark).count() == 7


def greedy(times, interval):
    passing = []
    for moment in sorted(times):
        if not passing or moment - passing[-1] >= interval:
            passing.append(moment)
    return passing


ALERT = "hostname string, type string, datetime timestamp, feature_name string, message string"


@pytest.mark.parametrize("minutes", [60, 0])
def test_throttle(spark, tmp_path, minutes):
    base = datetime(2024, 3, 1)
    times = [base + timedelta(minutes=m) for m in (0, 10, 59, 60, 61, 100, 120, 300, 301)]
    later = [base + timedelta(minutes=m) for m in (330, 361, 400)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def rows(moments):
        twice = [("hot", "expiration", t, name, "m") for t in moments for name in ("cad", "mesh")]
        return twice + [("cold", "expiration", moments[0], "cad", "m")]

    for moments in (times, later):
        alerts.throttle(stream_of(spark, rows(moments), ALERT, source), target, minutes, every=None).awaitTermination()
    out = alerts.Throttle(target, minutes).passing(spark)
    hot = sorted(r.datetime for r in out.collect() if r.hostname == "hot")
    assert hot == greedy(sorted((times + later) * 2), timedelta(minutes=minutes))
    assert out.where("hostname = 'cold'").count() == 2


@pytest.mark.parametrize("batch_rows", ["20", "10000"])
def test_throttle_does_not_depend_on_batches_and_files(spark, tmp_path, batch_rows):
    rng = random.Random(7)
    times = [datetime(2024, 3, 1) + timedelta(minutes=rng.randrange(60_000)) for _ in range(900)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("h", "expiration", t, "cad", "m") for t in times], ALERT).repartition(7).write.parquet(source)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        stream = spark.readStream.schema(ALERT).parquet(source)
        alerts.throttle(stream, target, 60, every=None).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = sorted(r.datetime for r in alerts.Throttle(target, 60).passing(spark).collect())
    assert got == greedy(times, timedelta(minutes=60))


def test_late_alerts_are_kept_aside(spark, tmp_path):
    base, source, target = datetime(2024, 3, 5), str(tmp_path / "in"), str(tmp_path / "out")
    for day in (3, 0, 3, 5):
        rows = [("h", "expiration", base + timedelta(days=day), f"f{day}", "m")]
        alerts.throttle(stream_of(spark, rows, ALERT, source), target, 60, every=None).awaitTermination()
    job = alerts.Throttle(target, 60)
    assert sorted(r.feature_name for r in job.passing(spark).collect()) == ["f3", "f5"]
    assert [r.feature_name for r in job.late(spark).collect()] == ["f0"]
    # The same batch again, with the state before it.
    job(spark.createDataFrame([("h", "expiration", base + timedelta(days=5), "f5", "m")], ALERT), 3)
    assert sorted(r.feature_name for r in job.passing(spark).collect()) == ["f3", "f5"]


def test_a_hot_key_is_read_in_order_and_not_gathered(spark, tmp_path):
    """A third of all alerts are one host's; nothing is collected per key."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"h{rng.randrange(9)}", "expiration", datetime(2024, 3, 1) + timedelta(seconds=rng.randrange(10 ** 6)),
             "cad", "m") for i in range(6000)] + [("hot", "expiration", None, "cad", "m")]
    job = alerts.Throttle(str(tmp_path), 60)
    for batch in (0, 1):
        job(spark.createDataFrame([r for i, r in enumerate(rows) if (r[2] or rows[0][2]) < datetime(2024, 3, 6) or batch], ALERT), batch)
    got = {}
    for r in job.passing(spark).collect():
        got.setdefault(r.hostname, []).append(r.datetime)
    for host in {r[0] for r in rows}:
        assert sorted(got[host]) == greedy({r[2] for r in rows if r[0] == host and r[2]}, timedelta(minutes=60))
    assert job.late(spark).where("datetime IS NULL").count() == 2


STREAMS = ["stream_usage_ingest", "stream_alert_throttle", "stream_status_feed"]


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_a_folder_of_part_files(spark, tmp_path, name):
    sf, parts = "/root/testdata/sf0.001", str(tmp_path)
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(f"{parts}/events.parquet")
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(f"{parts}/nation.parquet")
    whole, split = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in (sf, parts))
    assert whole == split and whole


def test_two_hosts_captured_in_the_same_second(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    for host in (HOST, "27000@other.example.org"):
        capture(source, "20240301120500", text("cad", 3, "mesh 1.0 4 acme permanent\n"), host=host)
    ingest.collect(stream_dumps(spark, str(source)), store, every=None).awaitTermination()
    collector = ingest.Collector(store)
    for table in (collector.features(spark, 0), collector.usage(spark)):
        ids = [r.id for r in table.collect()]
        assert len(ids) == 4 and len(set(ids)) == 4


def test_store_does_not_keep_old_copies(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    for k in range(4):
        capture(source, f"2024030{k + 1}120500", text("cad", k))
        ingest.collect(stream_dumps(spark, str(source)), str(store), every=None).awaitTermination()
    assert sorted(p.name for p in (store / "features").iterdir()) == ["batch_id=2", "batch_id=3"]
    assert list((store / "polled").iterdir()) == []
    assert sorted(p.name for p in (store / "feature_usage").glob("date=*")) == [f"date=2024-03-0{k}" for k in range(1, 5)]
    ids = [r.id for r in ingest.Collector(str(store)).usage(spark).orderBy("date").collect()]
    assert ids == sorted(ids) and len(set(ids)) == 4


def test_dispatch(spark, tmp_path):
    now = datetime(2024, 3, 31, 12)
    rows = spark.createDataFrame([
        (1, "h1", "cad", "expiration", "m1", "critical", False, None, now),
        (2, "h1", "cad", "expiration", "m2", "info", False, None, now)], ALERTS)
    dispatcher = alerts.Dispatcher(str(tmp_path), ["a@x"], ["b@x"])
    messages = dispatcher.render(rows, 1)
    assert messages.count() == 2
    left = dispatcher.settle(rows, messages.where("id = 1"), now, 1)
    assert [r.id for r in queue.unsent_alerts(left).collect()] == [2]


def test_feed(spark, tmp_path):
    capture(tmp_path, "20240301120500", text("cad", 3))
    messages = feed.status_messages(read_dumps(spark, str(tmp_path)))
    row = feed.subscribed(messages, [f"server:{HOST}"]).first()
    assert '"service":"up"' in row.data and '"name":"cad"' in row.data and '"users":[]' in row.data
    assert feed.subscribed(messages, ["alerts"]).count() == 0 and feed.subscribed(messages, ["all"]).count() == 1


def test_status_feed_of_a_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for stamp, used in (("20240301120500", 3), ("20240301121000", 4)):
        capture(source, stamp, text("cad", used))
        capture(source, stamp, "Cannot connect to license server\n", host="other")
        feed.status_feed(stream_dumps(spark, str(source)), target, every=None).awaitTermination()
    messages = feed.StatusFeed(target).messages(spark)
    assert messages.count() == 4
    mine = feed.subscribed(messages, [f"server:{HOST}"]).orderBy("timestamp").collect()
    assert ['"used_licenses":3' in mine[0].data, '"used_licenses":4' in mine[1].data] == [True, True]
    down = feed.subscribed(messages, ["server:other"]).first()
    assert '"service":"down"' in down.data and '"features":[]' in down.data


def lines_left(spark):
    folder = spark.sparkContext.getCheckpointDir()
    return set(Path(urlparse(folder).path).glob("rdd-*")) if folder else set()


def test_status_feed_keeps_its_messages_only(spark, tmp_path):
    source, target, before = tmp_path / "in", str(tmp_path / "out"), lines_left(spark)
    for stamp, used in (("20240301120500", 3), ("20240301121000", 4)):
        capture(source, stamp, text("cad", used))
        feed.status_feed(stream_dumps(spark, str(source)), target, every=None).awaitTermination()
    feed.StatusFeed(target)(read_dumps(spark, str(source)), 1)
    feed.StatusFeed(target)(read_dumps(spark, str(source)).limit(0), 2)
    assert feed.StatusFeed(target).messages(spark).count() == 3
    assert lines_left(spark) == before
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None


def test_micro_batches_take_as_many_compressed_bundles_as_asked(spark, tmp_path):
    rows = [(str(n % 20), f"h{n % 3}", "flexlm", datetime(2024, 3, 1, 12, n % 20), text("cad", n % 20)) for n in range(23)]
    rows += [("r", "h", "rlm", datetime(2024, 3, 1), "rlm status on a\n"), (None, "h", "flexlm", None, "x"), ("n", "h", None, None, "x")]
    rows = spark.createDataFrame(rows, "dump_id string, host string, server_type string, captured_at timestamp, text string")
    source = tmp_path / "in"
    write_bundles(rows.repartition(5, "dump_id"), str(source), compression="gzip")
    bundles = list(source.glob("*.txt.gz"))
    assert 1 < len(bundles) <= 5 and not list(source.glob("*.txt"))
    for limit, batches in ((1, len(bundles)), (1 << 20, 1)):
        target = tmp_path / f"out{limit}"
        feed.status_feed(stream_bundles(spark, str(source), bytes_per_trigger=limit), str(target), every=None).awaitTermination()
        assert len(list((target / "messages").glob("batch_id=*"))) == batches
        got, want = (sorted(map(str, m.collect())) for m in (feed.StatusFeed(str(target)).messages(spark), feed.status_messages(rows)))
        assert got == want and len(got) == 25


def test_status_texts_query_leaves_compressed_texts_and_messages(spark, tmp_path, monkeypatch):
    sf, kept = str(tmp_path / "sf"), tmp_path / "kept"
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-03 10:00:00' + make_dt_interval(0, 0, id) AS ts, id AS user_id,
        'view' AS event_type, double(id % 50) AS value, concat('{"k": ', id % 23, '}') AS props FROM range(100)""") \
        .write.parquet(f"{sf}/events.parquet")
    spark.sql("SELECT int(id) AS n_nationkey, concat('N', id) AS n_name, 0 AS n_regionkey FROM range(25)").write.parquet(f"{sf}/nation.parquet")
    monkeypatch.setattr(queries.export, "new_folder", lambda spark, kind: str(kept))
    before, found = lines_left(spark), {}
    for limit in (1 << 20, 1):
        monkeypatch.setattr(queries, "FEED_BYTES", limit)
        kept = tmp_path / f"kept{limit}"
        found[limit] = sorted(map(str, QUERIES["stream_status_texts"](spark, sf).collect()))
        assert list((kept / "texts").glob("*.txt.gz")) and not list((kept / "texts").glob("*.txt"))
        assert (len(list((kept / "feed/messages").glob("batch_id=*"))) > 1) == (limit == 1)
    assert found[1] == found[1 << 20] and len(found[1]) == 100
    assert lines_left(spark) == before
