"""One series with a third of all samples: the same numbers as pandas, and no window over whole series."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seatmeter.operators import forecast, stats, usage

AS_OF = datetime(2024, 6, 30, 12)
DAYS = 60


@pytest.fixture(scope="module")
def samples(spark):
    n = F.col("id")
    hot = n % 3 == 0
    place = F.when(hot, (n / 3).cast("int")).otherwise((n / 800).cast("int") * 60)
    at = F.lit("2024-05-10").cast("timestamp") + F.make_dt_interval(mins=place)
    rows = spark.range(120_000).select(
        "id", F.lit("h").alias("server_hostname"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), n % 800)).alias("feature_name"),
        F.to_date(at).alias("date"), F.date_format(at, "HH:mm:00").alias("time"),
        (F.pmod(F.xxhash64("id"), F.lit(97)) + F.when(n % 5003 == 0, 400).otherwise(0)).cast("int").alias("users_count"),
    )
    return rows.dropDuplicates(["server_hostname", "feature_name", "date", "time"])


@pytest.fixture(scope="module")
def features(samples):
    return samples.select("server_hostname", F.col("feature_name").alias("name")).distinct().select(
        F.lit(1).alias("id"), "*", F.lit(100).alias("total_licenses"))


@pytest.fixture(scope="module")
def local(samples):
    frame = samples.toPandas().sort_values(["feature_name", "date", "time"])
    assert (frame.feature_name == "hot").mean() > 0.33
    return frame


def test_statistics(samples, features, local):
    found = stats.enhanced_statistics(samples, features, AS_OF, DAYS).toPandas().set_index("feature_name")
    assert len(found) == local.feature_name.nunique()
    for name in ("hot", "s1", "s799"):
        part = local[local.feature_name == name]
        x = (pd.to_datetime(part.date) - pd.to_datetime(part.date.min())).dt.days
        row = found.loc[name]
        assert row.avg_usage == pytest.approx(part.users_count.mean())
        assert row.median_usage == part.users_count.median()
        assert row.std_dev == pytest.approx(part.users_count.std(ddof=0))
        assert row.moving_avg_30day == pytest.approx(part.users_count.tail(30).mean())
        assert row.trend_slope == pytest.approx(np.polyfit(x, part.users_count, 1)[0], abs=1e-9)


def test_anomalies(samples, features, local):
    by_series = local.groupby("feature_name").users_count
    z = (local.users_count - by_series.transform("mean")) / by_series.transform(lambda v: v.std(ddof=0))
    enough = by_series.transform("count") >= 7
    wanted = local[(z.abs() > 2) & enough]
    found = forecast.anomalies(samples, features, AS_OF, DAYS).toPandas()
    key = ["feature_name", "date", "time"]
    assert set(map(tuple, found[key].values)) == set(map(tuple, wanted[key].values))
    assert (found.feature_name == "hot").any()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(samples, features):
    ranked = plan_of(stats.enhanced_statistics(samples, features, AS_OF, DAYS))
    assert ranked.count("+- Window [") == ranked.count("WindowGroupLimit") // 2 == 1
    assert "Window" not in plan_of(forecast.anomalies(samples, features, AS_OF, DAYS))
    assert "Window" not in plan_of(usage.usage_stats(samples, features, AS_OF, DAYS))
    assert "CartesianProduct" not in ranked and "BroadcastNestedLoopJoin" not in ranked
