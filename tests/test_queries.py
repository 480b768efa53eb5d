"""Every registered query against its SQL counterpart, on the smallest test tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from seatmeter.plans.queries import QUERIES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = queries()[name](spark, SF)
    cursor = db.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = queries()["server_type_distribution"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_regionkey" not in plan
    plan = queries()["checkouts_by_name"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "BroadcastHashJoin" in plan
