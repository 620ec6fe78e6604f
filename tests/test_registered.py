"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from __spark_entry__ import entry
from checks.compare import connect, difference
from checks.oracles import oracle_sql
from checks.queries import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


def test_each_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF_DIR), name, SF_DIR) is None


def test_entry_gives_a_profile(spark):
    rows = entry(spark).collect()
    assert sorted(row.hour_ist for row in rows) == list(range(24))


def test_diurnal_pivot_takes_all_dates(spark, tmp_path):
    late = "SELECT event_id, ts + INTERVAL 60 DAYS AS ts, user_id, event_type, value, props FROM events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").createOrReplaceTempView("events")
    spark.sql(late).write.parquet(f"{tmp_path}/events.parquet")
    assert "2024-03-10" in queries()["diurnal_pivot"](spark, str(tmp_path)).columns
