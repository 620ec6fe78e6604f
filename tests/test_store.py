from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

import pytest

from aeroseries.config import GASES, ScaleLimits
from aeroseries.operators.quality_control import apply_quality_control
from aeroseries.plans.batch import run
from aeroseries.sources.store import GasStore, write_table
from tests.helpers import START, make_readings


def clean_rows(spark, days, first=START):
    rows = [
        (first + timedelta(days=d, hours=h), 1.0 + h, 400.0 + d, None if h == 3 else 1.9)
        for d in range(days)
        for h in range(0, 24, 3)
    ]
    return apply_quality_control(make_readings(spark, rows))


@pytest.fixture
def store(spark, tmp_path):
    store = GasStore(spark, str(tmp_path / "out"))
    store.save_batch(clean_rows(spark, 70))
    return store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_saved_by_ist_month(store):
    stats = {(r.year, r.month): r for r in store.partition_stats().collect()}
    assert {key: r.row_count for key, r in stats.items()} == {(2025, 11): 240, (2025, 12): 248, (2026, 1): 72}
    assert stats[(2026, 1)].max_date == date(2026, 1, 9)
    assert [r.label for r in store.available_months().orderBy("month_ist").collect()] == ["Nov 2025", "Dec 2025", "Jan 2026"]
    assert store.summarize().first().row_count == 560


def test_range_is_pruned_to_its_months_and_pushed_down(store):
    df = store.load_range("2025-12-30", date(2026, 1, 2), ["co_sync"])
    assert df.columns == ["datetime_ist", "co_sync"]
    rows = df.collect()
    assert len(rows) == 32 and rows == sorted(rows)
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "year" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(date_ist" in scan
    assert "ReadSchema: struct<datetime_ist:timestamp_ntz,date_ist:date,co_sync:double>" in scan
    assert len({f.split("/month=")[1][:2] for f in df.inputFiles()}) <= 3


def test_hourly_means_and_routing(store):
    raw = store.load_for_views("2025-11-01", "2025-11-02")
    assert "datetime_ist" in raw.columns and raw.count() == 16
    ratio = store.load_for_views("2025-11-01", "2025-11-02", ["co2_over_co_plus_co2"])
    assert sorted(ratio.columns) == ["co2_sync", "co_sync", "date_ist", "datetime_ist", "hour_ist"]
    assert not store.hourly_exists()
    store.rebuild_hourly()
    assert store.hourly_exists() and store.hourly().count() == 560
    hourly = store.load_for_views("2025-11-01", "2025-11-02")
    assert hourly.count() == 16 and "datetime_ist" in hourly.columns
    assert store.load_hourly_range("2026-01-01", "2026-01-01").columns == ["hour_start_ist", "date_ist", "hour_ist", *GASES]


def test_hourly_years_are_rebuilt_alone(spark, store):
    store.rebuild_hourly()
    extra = clean_rows(spark, 1, START + timedelta(days=100))
    store.save_batch(extra)
    store.rebuild_hourly([2026])
    assert store.hourly().count() == 568
    store.drop_months([(2026, 1), (2026, 2)])
    store.rebuild_hourly([2026])
    assert store.hourly().select("year").distinct().collect() == [(2025,)]


def test_compaction_touches_only_fragmented_months(spark, store):
    for day in range(3):
        store.save_batch(clean_rows(spark, 1, START + timedelta(days=100 + day)))
    before = {(r.year, r.month, r.series_bucket): r.files for r in store.fragmented_cells().collect()}
    rows = sorted(tuple(r) for r in store.raw().select("datetime_utc", "co_sync").collect())
    assert (2026, 2, 0) in before
    assert set(store.compact()) == set(before)
    assert store.fragmented_cells().count() == 0
    assert sorted(tuple(r) for r in store.raw().select("datetime_utc", "co_sync").collect()) == rows
    assert store.compact() == []


def test_parameterized_sql(store):
    sql = "SELECT count(*) AS n FROM readings WHERE date_ist = :day"
    assert store.query(sql, {"day": date(2025, 11, 5)}).first().n == 8
    with pytest.raises(Exception, match="nowhere"):
        store.query("SELECT * FROM nowhere").collect()


def test_sql_on_a_date_opens_its_month_alone(spark, store):
    store.register_views()
    plan = plan_of(spark.sql("SELECT count(*) FROM readings WHERE date_ist = DATE '2025-11-05'"))
    assert "dynamicpruning" in plan.split("PartitionFilters:")[1].split("]")[0]
    # A month that is opened would be found broken.
    for file in store.raw().inputFiles():
        if "/month=12/" in file:
            Path(file.removeprefix("file://")).write_bytes(b"broken")
    for name in Path(store.raw_path).glob("year=*/month=12/*/.*.crc"):
        name.unlink()
    assert store.query("SELECT count(*) AS n FROM readings WHERE date_ist = :day", {"day": date(2025, 11, 5)}).first().n == 8
    with pytest.raises(Exception, match="(?i)parquet"):
        store.query("SELECT sum(co_sync) FROM readings").collect()


def test_a_rebuild_leaves_the_version_in_force_readable(spark, store):
    store.rebuild_hourly()
    before = store.hourly()
    store.save_batch(clean_rows(spark, 1, START + timedelta(days=100)))
    store.rebuild_hourly()
    assert (before.count(), store.hourly().count()) == (560, 568)
    # What a rebuild that failed has left does not count.
    broken = Path(store.hourly_path) / "version=000009" / "year=2025"
    broken.mkdir(parents=True)
    assert store.hourly().count() == 568
    store.rebuild_hourly()
    assert len([p for p in Path(store.hourly_path).iterdir() if (p / "_SUCCESS").exists()]) == 2


def test_large_cells_are_several_files_and_full_files_are_left_alone(spark, tmp_path):
    small = GasStore(spark, str(tmp_path / "s"), ScaleLimits(target_file_bytes=20_000))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4096")
    try:
        small.save_batch(clean_rows(spark, 300))
        assert len(small.raw().inputFiles()) > len(small.cells_of(small.raw_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = small.raw().count()
    small.compact()
    assert small.fragmented_cells().count() == 0 and small.raw().count() == rows


def test_write_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert spark.read.parquet(write_table(df, str(tmp_path / "t.parquet"))).collect() == [(1, "x")]
    assert spark.read.option("header", True).csv(write_table(df, str(tmp_path / "t.csv"))).collect() == [("1", "x")]


def test_whole_run(spark, tmp_path):
    month = tmp_path / "raw" / "11"
    month.mkdir(parents=True)
    lines = [f"2025-11-01 {h:02d}:00:00 1.{h} 40{h % 10}.0 1.9" for h in range(24)]
    (month / "x-DataLog_User_Sync.dat").write_text("\n".join(["DATE TIME CO_sync CO2_sync CH4_sync", *lines]))
    out, logs = str(tmp_path / "out"), str(tmp_path / "logs")
    store = run(spark, str(tmp_path / "raw"), out, logs, ["11"])
    assert store.raw().count() == 24 and store.hourly().count() == 24
    report = spark.read.option("header", True).csv(f"{logs}/qa_report.csv")
    assert {r["column"]: r["rows"] for r in report.collect()} == {g: "24" for g in (*GASES, "datetime_utc")}
    assert spark.read.option("header", True).csv(f"{out}/hourly_mean_ist.csv").count() == 24
    for gas in GASES:
        assert spark.read.option("header", True).csv(f"{out}/monthly_diurnal_24point_{gas}.csv").count() == 24
