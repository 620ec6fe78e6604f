from __future__ import annotations

from datetime import date, datetime

import pytest

from aeroseries.operators.standardize import keep_first_reading, standardize, validate_rows
from aeroseries.schema import RAW_SCHEMA, STANDARD_COLUMNS
from tests.helpers import START, make_readings


def raw(spark, rows):
    full = [(*row, "a.dat", i) if len(row) == 5 else row for i, row in enumerate(rows)]
    return spark.createDataFrame(full, RAW_SCHEMA)


def test_columns_and_ist(spark):
    out = standardize(
        raw(spark, [("2025-11-01", "00:00:00", "1.0", "400.0", "1.8"), ("2025-11-01", "01:00:00", "1.5", "405.0", "1.9")])
    )
    assert tuple(out.columns) == STANDARD_COLUMNS
    first = out.orderBy("datetime_utc").first()
    assert first.datetime_ist == datetime(2025, 11, 1, 5, 30)
    assert first.hour_start_ist == datetime(2025, 11, 1, 5)
    assert (first.date_ist, first.hour_ist, first.day_ist, first.month_ist) == (date(2025, 11, 1), 5, 1, "2025-11")
    assert first.co_sync == first.co_sync_raw == 1.0


def test_ist_date_and_month_roll_over(spark):
    row = standardize(raw(spark, [("2025-12-31", "18:30:00", "1", "2", "3")])).first()
    assert (row.date_ist, row.hour_ist, row.month_ist) == (date(2026, 1, 1), 0, "2026-01")


def test_rows_are_trimmed_and_filtered(spark):
    rows = [
        (" 2025-11-01 ", " 00:00:00.123 ", "1", "2", "3"),
        ("01/11/2025", "00:00:00", "1", "2", "3"),
        ("2025-11-01", "0:00:00", "1", "2", "3"),
        (None, "00:00:00", "1", "2", "3"),
        ("2025-11-01", None, "1", "2", "3"),
    ]
    kept = validate_rows(raw(spark, rows)).collect()
    assert [(r.DATE, r.TIME) for r in kept] == [("2025-11-01", "00:00:00.123")]
    assert standardize(raw(spark, rows)).first().datetime_utc == datetime(2025, 11, 1, 0, 0, 0, 123000)


def test_unreal_times_are_dropped(spark):
    rows = [("2025-13-01", "00:00:00", "1", "2", "3"), ("2025-11-01", "25:00:00", "1", "2", "3")]
    assert standardize(raw(spark, rows)).count() == 0


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.5", 1.5), ("-2e3", -2000.0), (" 7 ", 7.0), ("bad", None), ("", None), ("nan", None), ("NaN", None),
     ("1.5f", None), ("1.5d", None), ("0x1p3", None), (None, None), ("inf", float("inf"))],
)
def test_numbers(spark, text, value):
    assert standardize(raw(spark, [("2025-11-01", "00:00:00", text, "2", "3")])).first().co_sync_raw == value


def test_first_copy_is_kept(spark):
    rows = [
        ("2025-11-01", "00:00:00", "5", "2", "3", "b.dat", 0),
        ("2025-11-01", "00:00:00", "6", "2", "3", "a.dat", 9),
        ("2025-11-01", "00:00:00", "7", "2", "3", "a.dat", 10),
    ]
    for order in (rows, rows[::-1]):
        out = standardize(raw(spark, order)).collect()
        assert [(r.co_sync, r.source_file) for r in out] == [(6.0, "a.dat")]


def test_copies_are_dropped_before_the_shuffle(spark):
    df = make_readings(spark, [(START, 1.0, 1.0, 1.0)])
    plan = keep_first_reading(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="CH4_sync"):
        standardize(raw(spark, [("2025-11-01", "00:00:00", "1", "2", "3")]).drop("CH4_sync"))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu"])
def test_session_zone_moves_nothing(spark, zone):
    # 02:30 on this day does not exist in New York
    rows = [("2024-03-10", "02:30:00", "1", "2", "3"), ("2024-03-09", "21:00:00", "1", "2", "3")]
    expected = sorted(tuple(r) for r in standardize(raw(spark, rows)).collect())
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert sorted(tuple(r) for r in standardize(raw(spark, rows)).collect()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert expected[0][2] == datetime(2024, 3, 10, 2) and expected[1][2] == datetime(2024, 3, 10, 8)
