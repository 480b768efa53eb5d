"""Time-series operators on hand-made series, checked against plain Python."""

import statistics
from datetime import date, datetime, timedelta

import pytest

from seatmeter.operators import capacity, fit, forecast, stats, usage
from seatmeter.operators.usage import first_day, first_whole_day
from seatmeter.schemas import FEATURE_USAGE, FEATURES

AS_OF = datetime(2024, 3, 31, 12)
HOST = "27000@lic"


def daily(name, values, start=date(2024, 3, 10), clock="09:00:00"):
    return [(0, HOST, name, start + timedelta(days=i), clock, v) for i, v in enumerate(values)]


SERIES = {
    "rising": daily("rising", [10 + 2 * i for i in range(10)]),
    "falling": daily("falling", [10 - i for i in range(10)]),
    "flat": daily("flat", [5] * 10),
    "one_day": [(0, HOST, "one_day", date(2024, 3, 12), f"{h:02d}:00:00", h) for h in range(8)],
    "short6": daily("short6", [1, 5, 2, 8, 3, 9]),
    "short1": daily("short1", [4]),
    "spike": daily("spike", [10] * 29 + [100], date(2024, 3, 2)),
    "boundary": [(0, HOST, "boundary", date(2024, 2, 29) + timedelta(days=i), "10:00:00", 10 * (i + 1)) for i in range(4)],
    "gaps": [(0, HOST, "gaps", date(2024, 3, 20), "22:15:00", 7), (0, HOST, "gaps", date(2024, 3, 20), "03:40:00", 7)],
    "zero_total": daily("zero_total", [0, 1, 2, 3, 4, 5, 6, 7]),
    "no_feature": daily("no_feature", [3] * 9),
    "idle": daily("idle", [0] * 8),
}
TOTALS = {name: 60 for name in SERIES} | {"zero_total": 0, "rising": 60, "spike": 20}
del TOTALS["no_feature"]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([row for rows in SERIES.values() for row in rows], FEATURE_USAGE)


@pytest.fixture(scope="module")
def features(spark):
    now = datetime(2024, 3, 31)
    rows = [(i, HOST, name, "1", "v", total, 1, None, now, True) for i, (name, total) in enumerate(TOTALS.items())]
    rows.append((99, HOST, "rising", "2", "v", 1000, 1, None, now, True))
    return spark.createDataFrame(rows, FEATURES)


def by_name(df, *more):
    return {tuple(r[c] for c in ("feature_name", *more)) if more else r.feature_name: r for r in df.collect()}


def in_fit(name, days=30):
    start = first_whole_day(AS_OF, days)
    return sorted((r[3], r[4], r[5]) for r in SERIES[name] if r[3] >= start)


def line(points):
    xs = [(d - points[0][0]).days for d, _, _ in points]
    ys = [v for _, _, v in points]
    if len(set(xs)) == 1:
        return 0.0, statistics.fmean(ys)
    slope = statistics.linear_regression(xs, ys)
    return slope.slope, slope.intercept


def test_cutoffs():
    assert first_day(AS_OF, 30) == date(2024, 3, 1)
    assert first_whole_day(AS_OF, 30) == date(2024, 3, 2)
    assert first_whole_day(datetime(2024, 3, 31), 30) == date(2024, 3, 1)


def test_fit_against_python(samples):
    found = by_name(fit.fit_series(samples, AS_OF, 30))
    assert set(found) == set(SERIES)
    for name, row in found.items():
        points = in_fit(name)
        slope, intercept = line(points)
        ys = [v for _, _, v in points]
        assert row.slope == pytest.approx(slope, abs=1e-9), name
        assert row.intercept == pytest.approx(intercept, abs=1e-9), name
        assert row.mean == pytest.approx(statistics.fmean(ys))
        assert row.stddev == pytest.approx(statistics.pstdev(ys), abs=1e-9)
        assert (row.samples, row.last_value) == (len(ys), ys[-1])
    assert found["flat"].r_squared == 0 and found["one_day"].r_squared == 0
    assert found["rising"].r_squared == pytest.approx(1)
    assert found["boundary"].samples == 2


def test_known_line(spark):
    rows = daily("y", [5, 7, 9, 11, 13])
    row = fit.fit_series(spark.createDataFrame(rows, FEATURE_USAGE), AS_OF, 30).first()
    assert (row.slope, row.intercept, row.r_squared) == (pytest.approx(2), pytest.approx(5), pytest.approx(1))


def test_predictions(samples, features):
    found = by_name(forecast.predictive_summary(samples, features, AS_OF))
    assert set(found) == {"rising", "falling", "flat", "one_day", "spike", "zero_total", "idle"}
    # The line is at 28 on the last day and gains 2 a day: 16 days to 60.
    assert (found["rising"].total_licenses, found["rising"].days_to_capacity) == (60, 16)
    assert found["zero_total"].days_to_capacity == -1 and found["falling"].days_to_capacity == -1


def test_forecast(samples, features):
    found = by_name(forecast.forecast(samples, features, AS_OF), "days_ahead")
    assert len(found) == 7 * 30
    assert found["rising", 1].predicted_usage == pytest.approx(30)
    assert found["rising", 1].date == date(2024, 4, 1)
    assert found["falling", 30].predicted_usage == 0
    assert min(r.predicted_usage for r in found.values()) >= 0


def test_anomalies(samples, features):
    rows = forecast.anomalies(samples, features, AS_OF).collect()
    assert [(r.feature_name, r.usage, r.severity) for r in rows] == [("spike", 100, "high")]
    assert rows[0].expected == pytest.approx(13)


def test_trends(samples, features):
    found = by_name(forecast.trend_analysis(samples, features, AS_OF))
    assert (found["rising"].direction, found["rising"].capacity_at_risk) == ("increasing", True)
    assert found["rising"].recommended_action == "Consider increasing license count within 30 days"
    assert found["falling"].recommended_action == "Consider reducing license count to optimize costs"
    assert found["falling"].projected_usage_30_days == 0
    assert (found["flat"].direction, found["flat"].recommended_action) == ("stable", "No action required")
    assert found["spike"].recommended_action in (
        "Consider increasing license count within 30 days", "Immediately increase license count - at capacity")


def test_heatmap(samples):
    rows = usage.hourly_heatmap(samples, AS_OF, 30).collect()
    assert len(rows) == 24 * len(SERIES)
    gaps = {r.hour: (r.avg_usage, r.peak_usage) for r in rows if r.feature_name == "gaps"}
    assert gaps == {h: (7.0, 7) if h in (3, 22) else (0.0, 0) for h in range(24)}
    document = by_name(usage.heatmap_documents(samples, AS_OF, 30))["gaps"]
    assert [h.hour for h in document.hourly_data] == list(range(24))


def test_enhanced(samples, features):
    found = by_name(stats.enhanced_statistics(samples, features, AS_OF))
    assert "short1" not in found and "no_feature" not in found and "short6" in found
    for name, row in found.items():
        ys = [v for _, _, v in in_fit(name)]
        assert row.median_usage == pytest.approx(statistics.median(ys))
        assert row.moving_avg_7day == pytest.approx(statistics.fmean(ys[-7:]))
        assert row.moving_avg_30day == pytest.approx(statistics.fmean(ys[-30:]))
        assert (row.peak_usage, row.min_usage) == (max(ys), min(ys))
    assert found["gaps"].peak_hour == 3 and found["idle"].peak_hour == 0 and found["one_day"].peak_hour == 7
    assert found["zero_total"].efficiency_score == 0
    assert (found["rising"].trend_direction, found["rising"].trend_strength) == ("increasing", "strong")
    assert found["flat"].underutilized_hours == 9


@pytest.mark.parametrize("avg, peak, dev, total, score", [
    (50, 60, 1, 100, 100), (15, 15, 1, 100, 50), (90, 95, 1, 100, 85), (30, 90, 1, 100, 90), (50, 60, 31, 100, 90),
    (1, 100, 50, 100, 0), (50, 60, 1, 0, 0),
])
def test_efficiency(spark, avg, peak, dev, total, score):
    from pyspark.sql import functions as F

    row = spark.range(1).select(stats.efficiency_score(
        F.lit(float(avg)), F.lit(float(peak)), F.lit(float(dev)), F.lit(total))).first()
    assert row[0] == pytest.approx(score)


def test_recommendations(samples, features):
    rows = stats.recommendations(stats.enhanced_statistics(samples, features, AS_OF)).collect()
    found = {(r.feature_name, r.title): r for r in rows}
    assert ("rising", "Growing Demand Detected") in found and ("falling", "Declining Usage Trend") in found
    low = found["flat", "License Optimization Opportunity"]
    assert low.description == "Average utilization is only 8.3%. Consider reducing license count to optimize costs."
    assert low.impact == "Potential to reduce licenses by 30 without impacting users"
    assert ("spike", "Peak Capacity Reached") in found
    assert not [k for k in found if k[0] == "zero_total" and "Optimization" in k[1]]


def test_capacity(samples, features):
    trended = capacity.utilization_with_trend(samples, features, AS_OF)
    found = by_name(trended)
    assert set(found) == set(SERIES)
    assert found["no_feature"].total_licenses is None and found["no_feature"].utilization_pct == 0
    assert found["short6"].trend_slope == 0 and found["short6"].days_to_capacity == -1
    # From the last sample (28): slope * last day (18) is added to it, as the report does.
    assert found["rising"].days_to_capacity == int((60 - (2 * 9 + 28)) / 2)
    assert found["boundary"].avg_usage == pytest.approx(30), "the cutoff's own day counts for means"
    classes = {(r.feature_name, r.capacity_class) for r in capacity.capacity_classes(trended).collect()}
    assert {("zero_total", "low_utilization"), ("zero_total", "trending_up"), ("rising", "trending_up"),
            ("falling", "trending_down"), ("falling", "low_utilization")} <= classes
    summary = capacity.capacity_summary(trended).first()
    assert (summary.total_features, summary.total_servers) == (len(SERIES), 1)
    assert summary.features_trending_down == sum(c == "trending_down" for _, c in classes)
    titles = [r.title for r in capacity.capacity_recommendations(capacity.capacity_summary(trended)).collect()]
    assert titles == ["Underutilized Features Detected", "Growing Usage Trends"]
    assert capacity.capacity_summary(trended.where("false")).first().total_features == 0


def test_stats_and_history(samples, features):
    found = by_name(usage.usage_stats(samples, features, AS_OF))
    assert found["rising"].total_licenses == 60 and found["no_feature"].total_licenses is None
    assert found["rising"].avg_utilization_pct == pytest.approx(19 / 60 * 100)
    history = usage.usage_history(samples, AS_OF, 30, HOST, "boundary").collect()
    assert [r.users_count for r in history] == [20, 30, 40]
    strict = usage.usage_rows(samples, AS_OF, 30, HOST, "boundary").collect()
    assert [r.users_count for r in strict] == [40, 30]


def test_comparison(samples, features, spark):
    chosen = spark.createDataFrame([(HOST, "rising"), (HOST, "flat"), (HOST, "missing")],
                                   "server_hostname string, feature_name string")
    history = usage.series_comparison(samples, chosen, AS_OF, 30)
    assert {r.feature_name for r in history.collect()} == {"rising", "flat"}
    table = usage.comparison_table(history, [(HOST, "rising"), (HOST, "flat")]).orderBy("timestamp").collect()
    assert table[0].asDict() == {"timestamp": datetime(2024, 3, 10, 9), f"{HOST}:rising": 10, f"{HOST}:flat": 5}


def test_append(samples, spark):
    batch = spark.createDataFrame([
        (7, HOST, "flat", date(2024, 3, 10), "09:00:00", 50), (9, HOST, "flat", date(2024, 3, 28), "09:00:00", 8),
        (8, HOST, "flat", date(2024, 3, 28), "09:00:00", 6)], FEATURE_USAGE)
    fresh = usage.append_usage(samples, batch, date(2024, 3, 10)).collect()
    assert [(r.id, r.users_count) for r in fresh] == [(8, 6)]


def test_beyond_the_broadcast_bound(samples, features, monkeypatch):
    """Too many series for a broadcast: the same anomalies by a shuffled join."""
    from seatmeter import session

    wanted = forecast.anomalies(samples, features, AS_OF).collect()
    original = session.attach
    monkeypatch.setattr(forecast, "attach", lambda big, small, on: original(big, small, on, max_rows=1))
    assert forecast.anomalies(samples, features, AS_OF).collect() == wanted


def test_enhanced_statistics_reads_stored_samples_twice(spark, tmp_path):
    from seatmeter.sources import derived, tables

    sf, store = "/root/testdata/sf0.001", str(tmp_path)
    tables.write_usage(derived.feature_usage(spark, sf), store)
    samples = tables.read_table(spark, store, "feature_usage")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = stats.enhanced_statistics(samples, derived.pools(spark, sf), derived.AS_OF)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("FileScan parquet [server_hostname") == 2 and "ReusedExchange" in plan
