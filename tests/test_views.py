from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aeroseries.config import PAIRS
from aeroseries.operators.correlation import correlation_summary, fit_line, pair_stats
from aeroseries.operators.diurnal import (
    daily_mean_median,
    diurnal_matrix,
    diurnal_pivot,
    diurnal_stats,
    month_hour_day_matrix,
    monthly_diurnal,
)
from aeroseries.operators.hourly import (
    columns_for,
    correlation_frame,
    hourly_mean_timeseries,
    hourly_preaggregate,
)
from aeroseries.operators.ranges import clamp_range, default_day, filter_by_hours, full_range, resolve_range
from aeroseries.operators.report import quality_report, summarize
from aeroseries.plans.views import (
    FilterState,
    correlation_view,
    daily_view,
    diurnal_view,
    heatmap_view,
    hourly_view,
    snapshot,
    view_base,
)
from tests.helpers import START, make_readings

SAMPLE = [
    (datetime(2025, 11, 1, 0, 0), 1.0, 400.0, 1.8),
    (datetime(2025, 11, 1, 0, 15), 1.2, 402.0, 1.9),
    (datetime(2025, 11, 1, 0, 45), 1.4, 404.0, 2.0),
    (datetime(2025, 11, 2, 0, 0), 1.6, 406.0, 2.1),
]


@pytest.fixture
def sample(spark):
    return make_readings(spark, SAMPLE)


def test_hourly_means_fill_gaps(sample):
    rows = hourly_mean_timeseries(sample).orderBy("hour_start_ist").collect()
    assert len(rows) == 25
    assert rows[0].hour_start_ist == datetime(2025, 11, 1, 5) and rows[0].co2_sync == 401.0
    assert rows[1].co2_sync == 404.0 and rows[2].co2_sync is None and rows[-1].co2_sync == 406.0
    assert hourly_preaggregate(sample).count() == 3


def test_hourly_means_of_distant_times_stay_small_arrays(spark):
    far = make_readings(spark, [(datetime(1990, 1, 1), 1.0, 1.0, 1.0), (datetime(2020, 1, 1), 1.0, 1.0, 1.0)])
    assert hourly_mean_timeseries(far).count() == 24 * (date(2020, 1, 1) - date(1990, 1, 1)).days + 1


def test_hourly_means_of_nothing(spark):
    assert hourly_mean_timeseries(make_readings(spark, [])).count() == 0


def test_matrix_and_its_statistics(sample):
    matrix = diurnal_matrix(sample, "co2_sync")
    assert matrix.count() == 3
    five = diurnal_stats(matrix, "co2_sync").where("hour_ist = 5").first()
    assert (five["mean"], five["median"]) == (403.5, 403.5)
    assert five["std"] == pytest.approx(5 / 2**0.5) and five.upper - five.lower == pytest.approx(2 * five["std"])
    assert diurnal_stats(matrix, "co2_sync").where("hour_ist = 6").first()["std"] == 0.0
    first = daily_mean_median(matrix, "co2_sync").where("date_ist = '2025-11-01'").first()
    assert (first["mean"], first["median"]) == (402.5, 402.5)
    wide = diurnal_pivot(sample, "co2_sync", [date(2025, 11, 1), date(2025, 11, 2)])
    assert {tuple(r) for r in wide.collect()} == {(5, 401.0, 406.0), (6, 404.0, None)}
    month = month_hour_day_matrix(sample, "co2_sync")
    assert len(month.columns) == 33 and month.where("hour_ist = 5").first()["2"] == 406.0
    assert monthly_diurnal(sample, "co_sync").count() == 2


def test_empty_cells_stay_in_the_matrix(spark):
    df = make_readings(spark, [(START, None, 400.0, 1.9)])
    assert diurnal_matrix(df, "co_sync").collect()[0].co_sync is None
    assert daily_mean_median(diurnal_matrix(df, "co_sync"), "co_sync").first()["mean"] is None


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        ([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], (3, 1.0, 2.0, 0.0, 1.0)),
        ([(1.0, 5.0), (2.0, 5.0)], (2, None, 0.0, 5.0, None)),
        ([(1.0, 5.0), (1.0, 6.0)], (2, None, None, None, None)),
        ([(1.0, 5.0)], (1, None, None, None, None)),
        ([(1.0, None), (None, 2.0)], (0, None, None, None, None)),
        ([], (0, None, None, None, None)),
    ],
)
def test_pair_statistics(spark, pairs, expected):
    df = spark.createDataFrame(pairs, "co2_sync double, ch4_sync double")
    row = pair_stats(df, "co2_sync", "ch4_sync").first()
    found = (row.n, row.pearson_r, row.slope, row.intercept, row.r2)
    assert found == tuple(v if v is None else pytest.approx(v, abs=1e-9) for v in expected)
    assert fit_line(df, "co2_sync", "ch4_sync").count() == (2 if expected[0] >= 2 else 0)


def test_summary_of_pairs(sample):
    rows = {(r.x, r.y): r for r in correlation_summary(sample).collect()}
    assert set(rows) == {("co2_sync", "co_sync"), ("co2_sync", "ch4_sync")}
    assert rows[("co2_sync", "co_sync")].pearson_r == pytest.approx(1.0)


def test_ratios_need_a_positive_sum(spark):
    df = make_readings(spark, [(START, 0.0, 0.0, 1.0), (START + timedelta(hours=1), 1.0, 3.0, 1.0)])
    rows = correlation_frame(df).orderBy("datetime_ist").collect()
    assert rows[0].co_over_co_plus_co2 is None and rows[1].co_over_co_plus_co2 == 0.25
    assert "co_over_co_plus_co2" not in correlation_frame(df.drop("co_sync")).columns


def test_correlation_view(sample):
    view = correlation_view(sample, "CH4 vs CO2/(CO+CO2)", 23, 0)
    assert (view.fit_start_hour, view.fit_end_hour) == (0, 23)
    assert (view.x, view.y) == PAIRS["CH4 vs CO2/(CO+CO2)"]
    assert view.stats.first().n == 3 and view.points.count() == 3 and view.line.count() == 2
    assert correlation_view(sample, "CO vs CO2", 6, 5).stats.first().fit_end_hour == 6


def test_correlation_view_names_its_fit_hours(sample):
    for hours, label in (((23, 0), "all hours 00-23"), ((6, 5), "hours 05-06 IST")):
        view = correlation_view(sample, "CO vs CO2", *hours)
        assert view.fit_label == view.stats.first().fit_label == label
    assert correlation_view(sample, "CO vs CO2", 6, 5, fit_label="dawn").stats.first().fit_label == "dawn"


def test_ranges(sample):
    assert full_range(sample) == (date(2025, 11, 1), date(2025, 11, 2))
    assert tuple(clamp_range(sample, "2026-01-01", "2025-01-01").first()) == (date(2025, 11, 1), date(2025, 11, 2))
    assert resolve_range(sample.limit(0), "2026-01-01", "2026-01-02") is None
    assert default_day(sample).count() == 3
    assert filter_by_hours(sample, 6, 6).count() == 1
    assert summarize(sample.limit(0)).first().row_count == 0


def test_columns_for_ratios():
    assert columns_for("co2_over_co_plus_co2", "ch4_sync") == sorted(
        ["datetime_ist", "date_ist", "hour_ist", "co_sync", "co2_sync", "ch4_sync"]
    )


def test_hourly_view_counts_gaps_but_does_not_draw_them(sample):
    view = hourly_view(sample, "co2_sync")
    assert view.table.count() == 3
    summary = view.summary.first()
    assert (summary.points, summary.min, summary.max) == (25, 401.0, 406.0)


def test_snapshot(sample):
    shot = snapshot(sample, FilterState(date(2025, 11, 1), date(2030, 1, 1)))
    row = shot.summary.first()
    assert (row.row_count, row.start_date, row.end_date, row.has_data) == (4, date(2025, 11, 1), date(2025, 11, 2), True)
    assert set(shot.views) == {"correlation", "diurnal", "daily", "hourly", "heatmap"}
    assert shot.views["daily"].summary.first().days == 2
    one_day = snapshot(sample, FilterState(date(2020, 1, 1), date(2025, 11, 1))).summary.first()
    assert (one_day.row_count, one_day.end_date) == (3, date(2025, 11, 1))


def test_snapshot_names_its_range(sample):
    for first, label in ((date(2025, 11, 1), "01/11/2025 to 02/11/2025"), (date(2030, 1, 1), "02/11/2025")):
        assert snapshot(sample, FilterState(first, date(2030, 1, 1))).summary.first().range_label == label


def test_quality_report_without_flags_counts_repeated_times(sample):
    doubled = sample.unionByName(sample.limit(1)).withColumn("co_sync", F.lit(None).cast("double"))
    rows = {r.column: r for r in quality_report(doubled).collect()}
    assert rows["co_sync"].clean_missing == 5 and rows["co_sync"].clean_missing_pct == 100.0
    assert rows["co_sync"].hard_flags == 0 and rows["co_sync"].clean_mean is None
    assert rows["datetime_utc"].duplicate_rows == 1 and rows["datetime_utc"].rows == 5


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Scan ExistingRDD")


def test_one_scan_for_filled_hours_and_none_for_views(spark, sample, tmp_path):
    sample.write.parquet(str(tmp_path / "sample"))
    stored = spark.read.parquet(str(tmp_path / "sample"))
    assert scans(hourly_mean_timeseries(stored))[0] == 1
    assert scans(view_base(stored)) == (1, 0)
    shot = snapshot(stored, FilterState(date(2025, 11, 1), date(2025, 11, 2)))
    tables = [shot.summary, *(t for v in shot.views.values() for t in ([v.stats, v.points, v.line] if hasattr(v, "stats") else [v.table, v.summary]))]
    # The readings were scanned when the sums were made; the views read the sums.
    assert len(tables) == 12 and all(scans(table) == (0, 1) for table in tables)


def test_views_of_a_snapshot_are_the_views_of_its_rows(sample):
    shot = snapshot(sample, FilterState(date(2025, 11, 1), date(2025, 11, 2)))
    alone = {
        "diurnal": diurnal_view(sample, "co2_sync"), "daily": daily_view(sample, "co2_sync"),
        "hourly": hourly_view(sample, "co2_sync"), "heatmap": heatmap_view(sample, "co2_sync"),
    }
    for name, view in alone.items():
        for part in ("table", "summary"):
            found, expected = getattr(shot.views[name], part), getattr(view, part)
            assert found.columns == expected.columns
            assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_long_gap_is_unrolled_in_parts(spark):
    rows = [(START, 1.0, 1.0, 1.0), (START + timedelta(hours=2345), 2.0, None, 2.0), (START + timedelta(hours=2346), 3.0, 3.0, 3.0)]
    hours = hourly_mean_timeseries(make_readings(spark, rows)).orderBy("hour_start_ist").collect()
    assert len(hours) == 2347 and [r.co_sync for r in hours if r.co_sync] == [1.0, 2.0, 3.0]
    assert all((b.hour_start_ist - a.hour_start_ist) == timedelta(hours=1) for a, b in zip(hours, hours[1:]))
    assert hourly_mean_timeseries(make_readings(spark, rows[:0])).count() == 0


def test_views_by_instrument(spark, sample):
    both = sample.withColumn("source_file", F.lit("one")).unionByName(sample.withColumns({"source_file": F.lit("two"), "co2_sync": F.col("co2_sync") + 1}))
    view = daily_view(both, "co2_sync", ["source_file"])
    assert view.table.columns[0] == "source_file" and view.table.count() == 2 * daily_view(sample, "co2_sync").table.count()
    means = {r.source_file: r.avg_mean for r in view.summary.collect()}
    assert means["two"] == pytest.approx(means["one"] + 1)
