"""Column expressions against known values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seatmeter.functions import dates, metrics as m
from seatmeter.operators import quality


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_available(spark):
    rows = [(10, 5), (10, 10), (10, 15), (10, 0)]
    t, u = F.col("t"), F.col("u")
    assert values(spark, m.available_clamped(t, u), rows, "t int, u int") == [5, 0, 0, 10]
    assert values(spark, m.available(t, u), rows, "t int, u int") == [5, 0, -5, 10]
    assert values(spark, m.percent_of(u, t), [(4, 1), (0, 3)], "t int, u int") == [25.0, 0.0]


def test_bytes_text(spark):
    sizes = [(0,), (500,), (1024,), (1536,), (1 << 20,), (1 << 30,), (1 << 40,)]
    assert values(spark, m.bytes_text(F.col("s")), sizes, "s bigint") == [
        "0 B", "500 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB", "1.0 TB"]


def test_fixed_rounds_exact_ties_to_even(spark):
    numbers = [(0.125,), (0.375,), (2.0,), (1234.5,)]
    assert values(spark, m.fixed(F.col("x"), 2), numbers, "x double") == ["0.12", "0.38", "2.00", "1234.50"]


def test_ages(spark):
    now = datetime(2024, 1, 10, 12)
    rows = [(datetime(2024, 1, 8, 9, 58),), (datetime(2024, 1, 10, 9, 58),), (datetime(2024, 1, 10, 11, 58),),
            (datetime(2024, 1, 10, 11, 59, 30),)]
    long = values(spark, m.age_long(F.col("t"), m.moment(now)), rows, "t timestamp")
    short = values(spark, m.age_short(F.col("t"), m.moment(now)), rows, "t timestamp")
    assert long == ["2d 2h 2m", "2h 2m", "2m", "0m"]
    assert short == ["2d 2h", "2h 2m", "2m", "30s"]


def test_days_until_truncates(spark):
    now = datetime(2024, 1, 10, 12)
    rows = [(datetime(2024, 1, 12),), (datetime(2024, 1, 11),), (datetime(2024, 1, 9),), (datetime(2024, 1, 8),)]
    assert values(spark, m.days_until(F.col("t"), m.moment(now)), rows, "t timestamp") == [1, 0, -1, -2]


def test_days_to_capacity(spark):
    rows = [(2.0, 60, 50.0), (2.0, 60, 55.5), (2.0, 60, 60.0), (-1.0, 60, 5.0), (1.0, 0, -4.0), (1e-30, 60, 1.0),
            (None, 60, 1.0), (1.0, None, 1.0)]
    reach = m.days_to_capacity(F.col("s"), F.col("t"), F.col("e"))
    assert values(spark, reach, rows, "s double, t int, e double") == [5, 2, -1, -1, -1, 2147483647, -1, -1]


def test_file_name_part(spark):
    names = [("27000@lic.example.org",), ("a b/c\\d:e",), ("x_-9",), ("..",), ("",)]
    assert values(spark, m.file_name_part(F.col("n")), names, "n string") == [
        "27000_licexampleorg", "a_b_c_d_e", "x_-9", "export", "export"]


@pytest.mark.parametrize("text, expected", [
    ("permanent", "2099-01-01"), ("", "2099-01-01"), (" PERMANENT ", "2099-01-01"), ("1-jan-2025", "2025-01-01"),
    ("01-JAN-2025", "2025-01-01"), ("2025-02-03", "2025-02-03"), ("02/03/2025", "2025-02-03"),
    ("2/3/2025", "2025-02-03"), ("Feb 3, 2025", "2025-02-03"), ("February 3 2025", "2025-02-03"),
    ("1-jan-0000", "2036-01-01"), ("1-jan-0", "2036-01-01"), ("1-jan-0005", "2099-01-01"),
    ("31-feb-2025", "2099-01-01"), ("soon", "2099-01-01"),
])
def test_expiry(spark, text, expected):
    found = values(spark, dates.expiry_timestamp(F.col("t")), [(text,)], "t string")
    assert found[0].date().isoformat() == expected


@pytest.mark.parametrize("host, good", [
    ("27000@license.example.com", True), ("27000@192.168.1.100", True), ("0@server.com", False),
    ("70000@server.com", False), ("abc@server.com", False), ("27000@", False), ("license.example.com:5053", True),
    ("192.168.1.100:5053", True), ("h.example.com:0", False), ("h.example.com:70000", False), (":5053", False),
    ("license.example.com", True), ("localhost", True), ("192.168.1.100", True), ("192.168.1.300", False),
    ("-invalid.com", False), ("", False), ("12345", False),
])
def test_host_notation(spark, host, good):
    reason = values(spark, quality.host_reason(F.col("h")), [(host,)], "h string")[0]
    assert (reason is None) == good, reason


def test_server_type(spark):
    rows = [("flexlm",), (" RLM ",), ("spm",), ("",)]
    assert [r is None for r in values(spark, quality.type_reason(F.col("t")), rows, "t string")] == [
        True, True, False, False]
