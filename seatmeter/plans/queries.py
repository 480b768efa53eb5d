"""Every registered query: (spark, folder of the test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmeter.operators import (
    alerts, board, capacity, changes, checkouts, cycles, extract, fit, flexlm, forecast, inventory, paging, profile,
    quality, retention, rlm, sessions, stats, usage,
)
from seatmeter.functions import metrics as m
from seatmeter.session import configure
from seatmeter.sinks import export
from seatmeter.sources import derived as d
from seatmeter.sources import dumps, tables
from seatmeter.sources.derived import AS_OF
from seatmeter.streaming import alerts as alert_stream
from seatmeter.streaming import feed, flow, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Compressed texts of one micro-batch of the status feed. What a micro-batch takes on disk besides goes when it is written.
FEED_BYTES = 128 << 20


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits compare equal."""
    return df.select(*[
        F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])


def query(make: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(configure(spark), sf_dir))

    QUERIES[make.__name__] = run
    return make


# --- inventory and samples


@query
def current_utilization(spark, sf):
    return inventory.current_utilization(d.pools(spark, sf))


@query
def features_snapshot(spark, sf):
    return d.features(spark, sf)


@query
def usage_dedup(spark, sf):
    return d.feature_usage(spark, sf)


@query
def usage_appended(spark, sf):
    polls = d.polls(spark, sf).select(
        F.col("poll_id").alias("id"), "server_hostname", "feature_name", F.to_date("sampled_at").alias("date"),
        F.date_format("sampled_at", "HH:mm:00").alias("time"), F.col("used_licenses").alias("users_count"))
    return usage.append_usage(d.earlier_usage(spark, sf), polls)


def _stored_usage(spark, sf):
    """The samples, written by day and read back as a stored table."""
    folder = export.new_folder(spark, "stored")
    tables.write_usage(d.feature_usage(spark, sf), folder)
    return tables.read_table(spark, folder, "feature_usage")


@query
def stored_history_of_series(spark, sf):
    """History of one series from the stored table; only the period's days are read."""
    return usage.usage_history(_stored_usage(spark, sf), AS_OF, 30, server="27000@nation-8.example.com", feature="view")


@query
def usage_stats_of_server(spark, sf):
    host = "27000@nation-3.example.com"
    return usage.usage_stats(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF, server=host)


@query
def feature_dedup_cleanup(spark, sf):
    return inventory.drop_duplicate_features(d.features(spark, sf))


@query
def features_evolved(spark, sf):
    return inventory.with_active_flag(d.features(spark, sf).drop("is_active"))


@query
def features_active(spark, sf):
    return inventory.features_of(d.features(spark, sf))


@query
def features_all(spark, sf):
    return inventory.features_of(d.features(spark, sf), active_only=False)


@query
def expiration_report(spark, sf):
    return inventory.expiration_report(d.features(spark, sf), AS_OF)


@query
def expiration_report_all(spark, sf):
    return inventory.expiration_report(d.features(spark, sf), AS_OF, include_inactive=True)


@query
def expiring_soon(spark, sf):
    return inventory.expiring_features(d.features(spark, sf), AS_OF, 10)


# --- usage


@query
def usage_history(spark, sf):
    return usage.usage_history(d.feature_usage(spark, sf), AS_OF)


@query
def usage_rows_strict(spark, sf):
    return usage.usage_rows(d.feature_usage(spark, sf), AS_OF)


@query
def usage_stats(spark, sf):
    return usage.usage_stats(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)


@query
def hourly_heatmap(spark, sf):
    return usage.hourly_heatmap(d.feature_usage(spark, sf), AS_OF, 30)


@query
def heatmap_documents(spark, sf):
    """One row per series; its 24 hours as text."""
    rows = usage.heatmap_documents(d.feature_usage(spark, sf), AS_OF, 30)
    hours = F.transform("hourly_data", lambda h: F.concat_ws(
        ":", h["hour"].cast("string"), F.round(h["avg_usage"] * 1000).cast("long").cast("string"), h["peak_usage"].cast("string")))
    return rows.withColumn("hourly_data", F.array_join(hours, " "))


@query
def series_comparison_table(spark, sf):
    """The comparison with a column per series."""
    chosen = [("27000@nation-3.example.com", "view"), ("27000@nation-8.example.com", "click")]
    wanted = spark.createDataFrame(chosen, "server_hostname string, feature_name string")
    table = usage.comparison_table(usage.series_comparison(d.feature_usage(spark, sf), wanted, AS_OF, 30), chosen)
    return table.toDF("timestamp", "first", "second")


@query
def series_comparison(spark, sf):
    chosen = usage.top_series(inventory.utilization_now(d.pools(spark, sf)))
    return usage.series_comparison(d.feature_usage(spark, sf), chosen, AS_OF)


def _searched_stats(spark, sf):
    rows = usage.usage_stats(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)
    return paging.search(rows, "Nation-1")


@query
def search_sort_page(spark, sf):
    ordered = paging.sorted_by(_searched_stats(spark, sf), paging.STATS_SORTS["peak"], descending=True,
                               ties=("server_hostname", "feature_name"))
    return paging.page_of(ordered, *paging.page_bounds(limit=10, page=2))


@query
def page_info(spark, sf):
    return paging.page_info(_searched_stats(spark, sf), *paging.page_bounds(limit=10, page=2))


@query
def deep_page(spark, sf):
    """A page in the second half of all samples, most users first."""
    rows = d.feature_usage(spark, sf).drop("id")
    directory = paging.PageDirectory(rows, [("users_count", True), ("date", False), ("time", False),
                                            ("server_hostname", False), ("feature_name", False)])
    return directory.page(*paging.page_bounds(limit=25, offset=directory.total * 3 // 4))


@query
def overview_tiles(spark, sf):
    return board.overview_tiles(inventory.utilization_now(d.pools(spark, sf)))


@query
def utilization_bands(spark, sf):
    return board.utilization_bands(inventory.utilization_now(d.pools(spark, sf))).select(
        "server_hostname", "feature_name", "version", "utilization_pct", "band")


# --- trends


@query
def linear_fit(spark, sf):
    return fit.fit_series(d.feature_usage(spark, sf), AS_OF, 30)


@query
def predictive_summary(spark, sf):
    return forecast.predictive_summary(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)


@query
def forecast_30d(spark, sf):
    return forecast.forecast(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)


@query
def anomalies(spark, sf):
    return forecast.anomalies(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)


@query
def trend_analysis(spark, sf):
    return forecast.trend_analysis(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)


def _enhanced(spark, sf):
    return stats.enhanced_statistics(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)


@query
def enhanced_statistics(spark, sf):
    return _enhanced(spark, sf)


@query
def efficiency_score(spark, sf):
    return _enhanced(spark, sf).select("server_hostname", "feature_name", "efficiency_score")


@query
def recommendations(spark, sf):
    return stats.recommendations(_enhanced(spark, sf))


def _trended(spark, sf):
    return capacity.utilization_with_trend(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)


@query
def utilization_with_trend(spark, sf):
    return _trended(spark, sf)


@query
def capacity_classes(spark, sf):
    return capacity.capacity_classes(_trended(spark, sf))


@query
def capacity_summary(spark, sf):
    return capacity.capacity_summary(_trended(spark, sf))


@query
def capacity_recommendations(spark, sf):
    return capacity.capacity_recommendations(capacity.capacity_summary(_trended(spark, sf)))


# --- alerts


@query
def expiry_alerts_throttled(spark, sf):
    return alerts.expiry_alerts(d.features(spark, sf), d.alert_events(spark, sf), AS_OF)


@query
def alerts_unsent(spark, sf):
    return alerts.unsent_alerts(d.alerts(spark, sf))


@query
def alerts_top_open(spark, sf):
    return alerts.top_unsent(d.alerts(spark, sf))


@query
def alerts_recent(spark, sf):
    return alerts.recent_alerts(d.alerts(spark, sf), AS_OF)


@query
def alerts_appended(spark, sf):
    new = alerts.expiry_alerts(d.features(spark, sf), d.alert_events(spark, sf), AS_OF)
    return alerts.append_alerts(d.alerts(spark, sf), new).drop("id")


@query
def alerts_mark_sent(spark, sf):
    queue = d.alerts(spark, sf)
    return alerts.mark_sent(queue, alerts.unsent_alerts(queue), AS_OF)


@query
def alert_messages(spark, sf):
    rendered = alerts.alert_messages(d.alerts(spark, sf), ["ops@example.com"], ["oncall@example.com"])
    return rendered.withColumn("recipients", F.array_join("recipients", ","))


# --- checkouts and boards


@query
def checkout_counts(spark, sf):
    return checkouts.checkout_counts(d.features(spark, sf), d.checkouts(spark, sf))


@query
def checkout_detail(spark, sf):
    return checkouts.checkout_detail(d.checkouts(spark, sf), AS_OF)


@query
def checkout_detail_of_feature(spark, sf):
    host = "27000@nation-8.example.com"
    return checkouts.checkout_detail(d.checkouts(spark, sf), AS_OF, server=host, feature="VIEW")


@query
def pool_checkouts(spark, sf):
    """Every checkout below its pools."""
    held = checkouts.pool_checkouts(d.features(spark, sf), d.held_checkouts(spark, sf), AS_OF)
    return held.select("id", "server_hostname", "feature_name", "license_version", "expiration_date", "username", "host",
                       "client_version", "checked_out_at", "age", "duration")


@query
def servers_from_files(spark, sf):
    """The configured servers, written as JSON and as CSV and read back."""
    folder, rows = export.new_folder(spark, "servers"), d.servers(spark, sf).withColumn("type", F.upper(F.concat("type", F.lit(" "))))
    rows.write.json(f"{folder}/json")
    rows.write.option("header", True).csv(f"{folder}/csv")
    return tables.read_servers(spark, f"{folder}/json").withColumn("file", F.lit("json")).unionByName(
        tables.read_servers(spark, f"{folder}/csv", "csv").withColumn("file", F.lit("csv")))


@query
def checked_out_only(spark, sf):
    return checkouts.checked_out_only(d.features(spark, sf), d.held_checkouts(spark, sf))


@query
def checkouts_by_name(spark, sf):
    return checkouts.counts_by_name(d.checkouts(spark, sf))


@query
def server_type_distribution(spark, sf):
    return board.server_type_distribution(d.servers(spark, sf))


@query
def dashboard_totals(spark, sf):
    return board.dashboard_totals(d.servers(spark, sf), d.features(spark, sf), d.alerts(spark, sf))


@query
def checkouts_with_type(spark, sf):
    typed = board.with_server_type(d.checkouts(spark, sf), d.moved_servers(spark, sf))
    return typed.select("server_hostname", "feature_name", "username", "server_type")


@query
def live_or_stored(spark, sf):
    return board.live_or_stored(d.live_pools(spark, sf), d.features(spark, sf))


@query
def status_board(spark, sf):
    """Latest status text of every configured server."""
    texts = d.redirected_dumps(spark, sf)
    return board.status_board(d.servers(spark, sf), extract.all_status(extract.latest_dumps(texts)))


@query
def host_quality(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    key = F.col("n_nationkey")
    host = F.concat(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit(".example.com"))
    form = key % 5
    written = (
        F.when(form == 0, F.concat(F.lit("27000@"), host)).when(form == 1, F.concat(host, F.lit(":5053")))
        .when(form == 2, F.concat(host, F.lit(":70000")))
        .when(form == 3, F.concat(F.lit("192.168.1."), key * 10 + 200)).otherwise(F.col("n_name"))
    )
    kind = F.when(key % 6 == 5, "spm").when(key % 3 == 0, " RLM ").otherwise("flexlm")
    return quality.host_quality(
        nation.select(key.cast("bigint").alias("id"), written.alias("hostname"), kind.alias("type")))


# --- retention


def _tables(spark, sf):
    return {
        "servers": d.servers(spark, sf), "features": d.features(spark, sf),
        "feature_usage": d.feature_usage(spark, sf), "license_events": d.license_events(spark, sf),
        "alerts": d.alerts(spark, sf), "alert_events": d.alert_events(spark, sf),
    }


@query
def table_stats(spark, sf):
    return retention.with_row_share(retention.table_stats(_tables(spark, sf)))


@query
def stored_table_stats(spark, sf):
    """Counts and span of the written tables, from file footers."""
    folder = export.new_folder(spark, "tables")
    for name, table in _tables(spark, sf).items():
        if name == "feature_usage":
            tables.write_by_day(table, folder, name)
        else:
            table.write.parquet(f"{folder}/{name}")
    return retention.stored_table_stats(spark, folder)


AGING = ["feature_usage", "license_events", "alerts", "alert_events"]


def _cleaned_folder(spark, sf):
    folder = export.new_folder(spark, "aging")
    stored = _tables(spark, sf)
    for name in AGING:
        tables.write_by_day(stored[name], folder, name)
    counts = [retention.clean_stored(spark, folder, name, AS_OF, 14) for name in AGING]
    return folder, counts


@query
def stored_cleanup(spark, sf):
    """Rows deleted from and kept in tables written by day."""
    counts = _cleaned_folder(spark, sf)[1]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query
def stored_usage_kept(spark, sf):
    """The samples that a written table holds after its cleanup."""
    return tables.read_by_day(spark, _cleaned_folder(spark, sf)[0], "feature_usage")


@query
def retention_stats(spark, sf):
    return retention.retention_stats(
        d.feature_usage(spark, sf), d.license_events(spark, sf), d.alerts(spark, sf), AS_OF)


@query
def retention_stats_later(spark, sf):
    later = datetime(2024, 4, 14, 12)
    return retention.retention_stats(
        d.feature_usage(spark, sf), d.license_events(spark, sf), d.alerts(spark, sf), later)


@query
def retention_cleanup(spark, sf):
    aging = {n: t for n, t in _tables(spark, sf).items() if n not in ("servers", "features")}
    return retention.cleanup_counts(aging, AS_OF, 14)


@query
def usage_kept(spark, sf):
    return retention.cleaned(d.feature_usage(spark, sf), "feature_usage", AS_OF, 14)


@query
def storage_advice(spark, sf):
    return retention.storage_advice(retention.table_stats(_tables(spark, sf)), d.features(spark, sf), large_usage=1000)


# --- status texts


@query
def dump_status(spark, sf):
    return extract.all_status(d.dumps(spark, sf))


@query
def flexlm_features(spark, sf):
    return flexlm.flexlm_features(d.dumps(spark, sf).where("server_type = 'flexlm'"))


@query
def rlm_features(spark, sf):
    return rlm.rlm_features(d.dumps(spark, sf).where("server_type = 'rlm'"))


@query
def all_features(spark, sf):
    return extract.all_features(d.dumps(spark, sf))


@query
def flexlm_checkouts(spark, sf):
    return flexlm.flexlm_checkouts(d.dumps(spark, sf).where("server_type = 'flexlm'"))


@query
def rlm_checkouts(spark, sf):
    return rlm.rlm_checkouts(d.dumps(spark, sf).where("server_type = 'rlm'"))


@query
def forms_status(spark, sf):
    return flexlm.flexlm_status(d.dump_forms(spark, sf))


@query
def forms_features(spark, sf):
    return flexlm.flexlm_features(d.dump_forms(spark, sf))


@query
def forms_checkouts(spark, sf):
    return flexlm.flexlm_checkouts(d.dump_forms(spark, sf))


@query
def unsupported_dumps(spark, sf):
    return extract.unsupported(d.other_dumps(spark, sf))


# --- streams, run over all available input


@query
def alerts_dispatched(spark, sf):
    """Render the queue's messages, then the next queue snapshot with them marked sent."""
    queue = d.alerts(spark, sf)
    dispatcher = alert_stream.Dispatcher(export.new_folder(spark, "dispatch"), ["ops@example.com"], ["oncall@example.com"])
    return dispatcher.settle(queue, dispatcher.render(queue, 1), AS_OF, 1)


@query
def stream_usage_ingest(spark, sf):
    samples = d.stream_polls(spark, sf).select(
        F.col("poll_id").alias("id"), "server_hostname", "feature_name", F.to_date("sampled_at").alias("date"),
        m.minute_text(F.col("sampled_at")).alias("time"), F.col("used_licenses").alias("users_count"))
    folder = export.new_folder(spark, "stream")
    ingest.distinct_samples(samples, folder, every=None).awaitTermination()
    return ingest.SampleLog(f"{folder}/samples").rows(spark)


@query
def stream_alert_throttle(spark, sf):
    due = d.stream_polls(spark, sf).where(F.col("expiration_date").between(
        F.col("sampled_at"), F.col("sampled_at") + F.make_dt_interval(F.lit(10))))
    candidates = due.select(
        F.col("server_hostname").alias("hostname"), F.lit("expiration").alias("type"),
        F.col("sampled_at").alias("datetime"), "feature_name", F.lit("license expires").alias("message"))
    folder = export.new_folder(spark, "stream")
    alert_stream.throttle(candidates, folder, 60, every=None).awaitTermination()
    return alert_stream.Throttle(folder, 60).passing(spark)


@query
def stream_status_feed(spark, sf):
    messages = feed.poll_messages(d.stream_polls(spark, sf))
    chosen = feed.subscribed(messages, [f"server:27000@nation-{n}.example.com" for n in (3, 8)])
    return flow.run_available(chosen, export.new_folder(spark, "stream"))


def _collected(spark, sf):
    """All status texts, written as bundles, read as a stream, extracted and stored."""
    folder = export.new_folder(spark, "collected")
    dumps.write_bundles(d.dumps(spark, sf), f"{folder}/texts")
    ingest.collect(dumps.stream_bundles(spark, f"{folder}/texts"), f"{folder}/store", every=None).awaitTermination()
    return ingest.Collector(f"{folder}/store")


@query
def collected_inventory(spark, sf):
    return _collected(spark, sf).features(spark, 0).drop("id")


@query
def collected_usage(spark, sf):
    return _collected(spark, sf).usage(spark).drop("id")


@query
def stream_status_texts(spark, sf):
    """Status messages of all texts, read from bundles; of their data the state and what the lists add up to."""
    folder = export.new_folder(spark, "texts")
    dumps.write_bundles(d.dumps(spark, sf), f"{folder}/texts", compression="gzip")
    texts = dumps.stream_bundles(spark, f"{folder}/texts", bytes_per_trigger=FEED_BYTES)
    feed.status_feed(texts, f"{folder}/feed", every=None).awaitTermination()
    data = F.from_json("data", "service string, features array<struct<used_licenses: int>>, users array<struct<username: string>>")
    messages = feed.StatusFeed(f"{folder}/feed").messages(spark).withColumn("data", data)
    used = F.aggregate("data.features.used_licenses", F.lit(0).cast("long"), lambda n, x: n + x)
    return messages.select("type", "channel", "timestamp", "data.service", F.size("data.features").alias("features"),
                           used.alias("used"), F.size("data.users").alias("users"))


@query
def alert_feed(spark, sf):
    return feed.subscribed(feed.alert_feed(d.alerts(spark, sf)), ["alerts"])


# --- exports, written and read back


def _csv_roundtrip(spark, layout):
    return export.read_csv_text(spark, export.write_csv(layout, export.new_folder(spark, "export")), layout.columns)


@query
def export_servers(spark, sf):
    return _csv_roundtrip(spark, export.servers_layout(d.servers(spark, sf)))


@query
def export_features(spark, sf):
    return _csv_roundtrip(spark, export.features_layout(inventory.features_of(d.features(spark, sf))))


@query
def export_utilization(spark, sf):
    return _csv_roundtrip(spark, export.utilization_layout(inventory.current_utilization(d.pools(spark, sf))))


@query
def export_history(spark, sf):
    return _csv_roundtrip(spark, export.history_layout(usage.usage_history(d.feature_usage(spark, sf), AS_OF, 30)))


@query
def export_stats(spark, sf):
    rows = usage.usage_stats(d.feature_usage(spark, sf), d.pools(spark, sf), AS_OF)
    return _csv_roundtrip(spark, export.stats_layout(rows))


@query
def export_json(spark, sf):
    rows = inventory.current_utilization(d.pools(spark, sf))
    folder = export.write_json(rows, export.new_folder(spark, "export"), AS_OF, server="")
    about = spark.read.schema("`count` bigint, exported_at string, server string").json(f"{folder}/about")
    return spark.read.schema(rows.schema).json(f"{folder}/rows").join(F.broadcast(about))


@query
def export_report(spark, sf):
    report = export.combined_report(d.servers(spark, sf), d.features(spark, sf), d.feature_usage(spark, sf), AS_OF)
    folder = export.write_report_csv(report, export.new_folder(spark, "export"))
    used = export.read_csv_text(spark, f"{folder}/utilization", [
        "Server", "Feature", "Version", "Total", "Used", "Available", "Utilization %"])
    stats = export.read_csv_text(spark, f"{folder}/statistics", [
        "Server", "Feature", "Avg Usage", "Peak Usage", "Min Usage", "Total Licenses"])
    return used.withColumn("section", F.lit("utilization")).unionByName(
        stats.withColumn("section", F.lit("statistics")), allowMissingColumns=True)


@query
def export_report_json(spark, sf):
    """All five sections of the report, written as JSON and read back, two texts and two numbers of each row."""
    report = export.combined_report(d.servers(spark, sf), d.features(spark, sf), d.feature_usage(spark, sf), AS_OF)
    folder = export.write_report_json(report, export.new_folder(spark, "export"))
    back = {name: spark.read.schema(rows.schema).json(f"{folder}/{name}") for name, rows in report.items()}
    peaks = F.aggregate("hourly_data.peak_usage", F.lit(0).cast("long"), lambda n, x: n + x)
    taken = {
        "summary": ("report_type", "server_filter", F.col("total_servers"), F.col("total_features")),
        "servers": ("hostname", "type", F.col("id"), F.length("webui")),
        "utilization": ("server_hostname", "feature_name", F.col("total_licenses"), F.col("used_licenses")),
        "statistics": ("server_hostname", "feature_name", F.col("peak_usage"), F.col("min_usage")),
        "heatmap": ("server_hostname", "feature_name", F.size("hourly_data"), peaks),
    }
    parts = [back[name].select(F.lit(name).alias("section"), F.col(a).alias("a"), F.col(b).alias("b"),
                               x.cast("long").alias("x"), y.cast("long").alias("y")) for name, (a, b, x, y) in taken.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def export_names(spark, sf):
    hosts = d.features(spark, sf).select("server_hostname", "name").distinct()
    return hosts.select("server_hostname", "name", m.file_name_part(F.col("server_hostname")).alias("file_part"),
                        m.file_name_part(F.concat("name", F.lit(" / (x)"))).alias("odd_part"))


# --- declared by the monitored system without a computation of their own


@query
def weekly_profile(spark, sf):
    return profile.weekly_profile(d.feature_usage(spark, sf))


@query
def weekday_weekend(spark, sf):
    return profile.weekday_weekend(d.feature_usage(spark, sf))


@query
def denials(spark, sf):
    return profile.denials(d.license_events(spark, sf))


@query
def feature_changes(spark, sf):
    log = d.polls(spark, sf)
    before = inventory.inventory_from_polls(log.where(F.col("polled_at") < F.lit("2024-01-30").cast("timestamp")))
    return profile.feature_changes(before.where("is_active"), d.features(spark, sf).where("is_active"))


@query
def inventory_refreshed(spark, sf):
    """The inventory of all but the last day, refreshed with the polls of the last day."""
    log = d.polls(spark, sf)
    last_day = F.col("polled_at") >= F.lit("2024-01-30").cast("timestamp")
    batch = log.where(last_day).select(
        F.col("poll_id").alias("id"), "server_hostname", "name", "version", "vendor_daemon", "total_licenses",
        "used_licenses", "expiration_date", F.col("polled_at").alias("last_updated"), F.lit(True).alias("is_active"))
    return inventory.refresh_inventory(inventory.inventory_from_polls(log.where(~last_day)), batch)


# --- events and changes over whole logs


@query
def checkout_sessions(spark, sf):
    return sessions.checkout_sessions(d.license_events(spark, sf))


@query
def peak_concurrency(spark, sf):
    return sessions.peak_concurrency(sessions.checkout_sessions(d.license_events(spark, sf)))


@query
def denials_at_capacity(spark, sf):
    return sessions.denials_at_capacity(d.license_events(spark, sf), d.tool_polls(spark, sf))


@query
def pool_history(spark, sf):
    return changes.pool_history(d.polls(spark, sf))


@query
def checkout_changes(spark, sf):
    """From all status texts: who appeared and who left between the captures of each server."""
    texts = extract.Parsed(d.dumps(spark, sf))
    return changes.checkout_changes(changes.captures_of(texts.status()), texts.checkouts())


@query
def seasonal_patterns(spark, sf):
    found = cycles.seasonal_patterns(d.feature_usage(spark, sf))
    values = lambda name: F.array_join(F.transform(
        name, lambda x: F.coalesce(F.round(x * 1000).cast("long").cast("string"), F.lit("-"))), ",").alias(name)
    return found.select(*[values(c) if c.endswith("_pattern") else F.col(c) for c in found.columns])


@query
def peak_periods(spark, sf):
    found = cycles.peak_periods(d.feature_usage(spark, sf))
    return found.withColumn("days_of_week", F.array_join(F.transform("days_of_week", lambda x: x.cast("string")), ","))
