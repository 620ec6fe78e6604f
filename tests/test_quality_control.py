from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from aeroseries.config import GASES, Bounds, QcConfig, ScaleLimits
from aeroseries.operators import quality_control as qc
from aeroseries.operators import time_blocks
from aeroseries.operators.quality_control import apply_quality_control, hour_profile, hour_statistics
from aeroseries.schema import QC_COLUMNS
from tests.helpers import START, actual_qc, expected_qc, hourly_rows, make_readings

TIGHT = QcConfig(
    point_spike_z=3.0, hourly_spike_z=1.5, sustained_shift_min_hours=2,
    hourly_reference_window_hours=12, hourly_reference_min_periods=4, hourly_group_min_samples=5,
)
SPREAD = ScaleLimits(rows_per_hour=1)
SHUFFLED = ScaleLimits(broadcast_hours=0)


def random_rows(seed, hours=60):
    rng = random.Random(seed)
    rows = []
    for hour in range(hours):
        if rng.random() < 0.1:
            continue
        level = 400 + (30 if 20 <= hour < 26 or hour == 40 else 0)
        for i in range(rng.randint(1, 12)):
            at = START + timedelta(hours=hour, minutes=i)
            value = [round(rng.gauss(level, 2), 2) for _ in GASES]
            if rng.random() < 0.05:
                value[rng.randrange(3)] = rng.choice([None, -5.0, float("nan"), 900.0])
            rows.append((at, *value))
    return rows


@pytest.mark.parametrize("limits", [ScaleLimits(), SPREAD, SHUFFLED], ids=["gathered", "spread", "shuffled"])
@pytest.mark.parametrize("config", [QcConfig(), TIGHT], ids=["default", "tight"])
def test_matches_sql_on_random_readings(spark, limits, config):
    rows = random_rows(7)
    out = apply_quality_control(make_readings(spark, rows), config, limits=limits)
    assert actual_qc(out) == expected_qc(rows, config)


@pytest.mark.parametrize("limits", [ScaleLimits(), SPREAD], ids=["gathered", "spread"])
def test_constant_hours_fall_back_to_all_raw_values(spark, limits):
    hours = [[400.0] * 8 + [430.0], [410.0] * 8 + [-3.0], [420.0] * 9 + [421.0], [405.0] * 7]
    rows = hourly_rows(hours)
    out = apply_quality_control(make_readings(spark, rows), TIGHT, limits=limits)
    found = actual_qc(out)
    assert found == expected_qc(rows, TIGHT)
    assert any(row[QC_COLUMNS.index("co_sync_flag_point_spike")] is False for row in found)
    assert out.where("co_sync_point_robust_z IS NULL AND co_sync_raw >= 0").count() == 0


def test_constant_series_has_no_scale(spark):
    rows = hourly_rows([[400.0] * 6] * 8)
    out = apply_quality_control(make_readings(spark, rows), TIGHT)
    assert actual_qc(out) == expected_qc(rows, TIGHT)
    assert out.where("co_sync_point_robust_z IS NOT NULL OR qc_any_excluded").count() == 0


def test_zero_mad_hour_uses_the_row_weighted_typical_scale(spark):
    wide = [398.0, 400.0, 402.0, 404.0, 396.0] * 3
    narrow = [400.0, 400.1, 399.9, 400.2, 399.8]
    rows = hourly_rows([wide, narrow, [400.0] * 12 + [450.0]])
    out = apply_quality_control(make_readings(spark, rows), QcConfig())
    assert actual_qc(out) == expected_qc(rows, QcConfig())
    spike = out.where("co_sync_raw = 450").first()
    # 15 of the 20 rows with a positive scale belong to the hour whose MAD is 2
    assert spike.co_sync_point_robust_z == pytest.approx(50 / (1.4826 * 2.0))
    assert spike.co_sync_flag_point_spike and spike.co_sync is None


def test_point_spike_needs_samples_and_is_strict(spark):
    calm = [399.0, 400.0, 401.0, 400.0, 399.0, 401.0, 400.0, 399.0, 401.0, 400.0]
    few = apply_quality_control(make_readings(spark, hourly_rows([[*calm, 500.0]])))
    enough = apply_quality_control(make_readings(spark, hourly_rows([[*calm, 400.0, 500.0]])))
    assert few.where("co_sync_flag_point_spike").count() == 0
    assert few.where("co_sync_raw = 500").first().co_sync_point_robust_z > 8
    assert [r.co_sync_raw for r in enough.where("co_sync_flag_point_spike").collect()] == [500.0]


def test_short_runs_are_spikes_and_long_runs_are_kept_shifts(spark):
    hours = [[400.0 + (h % 3)] * 5 for h in range(40)]
    hours[10] = [600.0] * 5
    for h in range(25, 29):
        hours[h] = [600.0] * 5
    config = QcConfig(
        hourly_reference_window_hours=30, hourly_reference_min_periods=5, sustained_shift_min_hours=3
    )
    rows = hourly_rows(hours)
    out = apply_quality_control(make_readings(spark, rows), config)
    assert actual_qc(out) == expected_qc(rows, config)
    hours = [row.hour_start_ist for row in out.where("co_sync_flag_hourly_spike").collect()]
    spikes = {(hour.day - 1) * 24 + hour.hour for hour in hours}
    shifts = out.where("co_sync_flag_sustained_shift")
    assert spikes == {10}
    assert shifts.count() == 20 and shifts.where("co_sync IS NULL").count() == 0
    assert out.where("qc_any_sustained_shift").count() == 20


def test_clock_gaps_do_not_break_a_run(spark):
    hours = [[400.0 + (h % 3)] * 5 for h in range(40)]
    for h in (20, 22):
        hours[h] = [600.0] * 5
    hours[21] = []
    config = QcConfig(hourly_reference_window_hours=30, hourly_reference_min_periods=5, sustained_shift_min_hours=1)
    rows = hourly_rows(hours)
    out = apply_quality_control(make_readings(spark, rows), config)
    assert actual_qc(out) == expected_qc(rows, config)
    assert out.where("co_sync_flag_sustained_shift").count() == 10


def test_gas_without_valid_values(spark):
    rows = [(START + timedelta(minutes=i), None, -1.0, 1.9) for i in range(15)]
    out = apply_quality_control(make_readings(spark, rows))
    assert actual_qc(out) == expected_qc(rows, QcConfig())
    row = out.first()
    assert row.co_sync_flag_hard and row.co2_sync_flag_hard and not row.ch4_sync_flag_hard
    assert row.co_sync_point_robust_z is None and row.co_sync_hourly_robust_z is None
    assert not row.co_sync_flag_point_spike and row.qc_any_excluded


def test_empty_frame(spark):
    out = apply_quality_control(make_readings(spark, []))
    assert out.count() == 0 and tuple(out.columns) == QC_COLUMNS


def test_bounds_can_be_open_or_closed(spark):
    rows = [(START + timedelta(minutes=i), v, v, v) for i, v in enumerate([-1.0, 5.0, 11.0])]
    config = QcConfig.from_mapping({"hard_bounds": {"co_sync": {"max": 10.0}, "co2_sync": {"min": None}}})
    assert config.bounds("co_sync") == Bounds(0.0, 10.0)
    flags = apply_quality_control(make_readings(spark, rows), config).orderBy("datetime_utc").collect()
    assert [r.co_sync_flag_hard for r in flags] == [True, False, True]
    assert [r.co2_sync_flag_hard for r in flags] == [False, False, False]


def test_good_readings_stay(spark):
    values = [(1.0, 400.0, 1.8), (1.2, 402.0, 1.9), (1.4, 404.0, 2.0), (1.6, 406.0, 2.1)]
    df = make_readings(spark, [(START + timedelta(minutes=15 * i), *v) for i, v in enumerate(values)])
    out = apply_quality_control(df.drop("hour_start_ist", *(f"{gas}_raw" for gas in GASES)))
    assert out.where("co_sync IS NULL OR co2_sync IS NULL OR ch4_sync IS NULL OR qc_any_excluded").count() == 0
    assert out.columns[: len(QC_COLUMNS)] == list(QC_COLUMNS)


def test_flags_are_consistent(spark):
    out = apply_quality_control(make_readings(spark, random_rows(3)), TIGHT)
    for gas in GASES:
        g = {name: F.col(f"{gas}_{name}") for name in
             ("flag_hard", "flag_point_spike", "flag_hourly_spike", "flag_sustained_shift", "qc_excluded", "raw")}
        any_flag = g["flag_hard"] | g["flag_point_spike"] | g["flag_hourly_spike"]
        broken = (g["qc_excluded"] != any_flag) | (g["flag_hourly_spike"] & g["flag_sustained_shift"])
        broken = broken | (F.col(gas).isNotNull() & (F.col(gas) != g["raw"])) | (F.col(gas).isNull() != g["qc_excluded"])
        assert out.where(broken).count() == 0


def test_order_and_partitions_do_not_matter(spark):
    rows = random_rows(5)
    expected = actual_qc(apply_quality_control(make_readings(spark, rows), TIGHT))
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert actual_qc(apply_quality_control(make_readings(spark, mixed).repartition(5), TIGHT)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("limits", [ScaleLimits(), SPREAD, SHUFFLED], ids=["gathered", "spread", "shuffled"])
def test_instruments_are_kept_apart(spark, limits):
    one, two = random_rows(11, 30), random_rows(12, 30)
    both = make_readings(spark, one).withColumn("site", F.lit("n")).unionByName(
        make_readings(spark, two).withColumn("site", F.lit("s"))
    )
    out = apply_quality_control(both, TIGHT, by=["site"], limits=limits)
    assert out.columns[-1] == "site"
    assert actual_qc(out.where("site = 'n'")) == expected_qc(one, TIGHT)
    assert actual_qc(out.where("site = 's'")) == expected_qc(two, TIGHT)


def test_profile(spark):
    profile = hour_profile(make_readings(spark, hourly_rows([[1.0] * 3, [1.0] * 7])))
    assert (profile.hours, profile.largest) == (2, 7)


def test_plan_has_no_python_and_broadcasts_the_hourly_table(spark):
    df = make_readings(spark, random_rows(2))
    plan = apply_quality_control(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "CartesianProduct" not in plan
    shuffled = apply_quality_control(df, limits=SHUFFLED)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in shuffled


@pytest.mark.parametrize("limits", [ScaleLimits(), ScaleLimits(rows_per_hour=1)], ids=["gathered", "spread"])
def test_infinite_readings_are_no_spikes_by_themselves(spark, limits):
    values = [400.0 + i % 3 for i in range(20)]
    mostly = hourly_rows([[*values[:8], *[float("inf")] * 12]])
    clean = apply_quality_control(make_readings(spark, mostly), QcConfig(), limits=limits)
    flags = [(row.ch4_sync_raw, row.ch4_sync_flag_point_spike, row.ch4_sync_point_robust_z) for row in clean.collect()]
    # The hour's median is infinite: no distance from it is a number, so nothing is a spike.
    assert not any(spike for _, spike, _ in flags) and all(z is None or z == z for *_, z in flags)


@pytest.mark.parametrize("limits", [ScaleLimits(), ScaleLimits(rows_per_hour=1)], ids=["gathered", "spread"])
def test_rows_without_a_time_form_no_hour(spark, limits):
    rows = hourly_rows([[400.0 + i % 5 for i in range(20)] for _ in range(5)])
    readings = make_readings(spark, rows)
    timeless = readings.limit(4).withColumn("datetime_ist", F.lit(None).cast("timestamp_ntz")).withColumn(
        "hour_start_ist", F.lit(None).cast("timestamp_ntz")
    )
    hours = hour_statistics(readings.unionByName(timeless), QcConfig(), limits=limits)
    assert hours.where("hour_start_ist IS NULL").count() == 0 and hours.count() == 15


def test_long_series_in_blocks_equal_the_window_form(spark, monkeypatch):
    monkeypatch.setattr(time_blocks, "BLOCK_ROWS", 50)
    monkeypatch.setattr(time_blocks, "STRETCH_HOURS", 36)
    rng = random.Random(3)
    config = QcConfig(hourly_spike_z=1.5, hourly_reference_window_hours=21, hourly_reference_min_periods=5, sustained_shift_min_hours=2)
    rows, at = [], START
    for _ in range(700):
        at += timedelta(hours=rng.choice([1, 1, 1, 2, 90]) if rng.random() < 0.2 else 1)
        for gas, scale in (("co_sync", 1.0), ("co2_sync", 0.0)):
            value = round(rng.gauss(10, scale), 2) + (30 if rng.random() < 0.2 else 0)
            rows.append(("ab"[len(rows) % 5 == 0], gas, at, 5, 5, value, 1.0, None if rng.random() < 0.05 else value))
    rows = list({row[:3]: row for row in rows}.values())
    schema = "who string, gas string, hour_start_ist timestamp_ntz, hour_rows long, hour_count long, hour_median double, hour_mad double, hour_reference double"
    hours = spark.createDataFrame(rows, schema)
    window, blocks = (qc.score_hours(hours, config, ["who"], long) for long in (False, True))
    assert set(window.columns) == set(blocks.columns)
    assert sorted(map(tuple, window.collect()), key=repr) == sorted(map(tuple, blocks.select(window.columns).collect()), key=repr)
    assert window.where("run_length > 2").count() and window.where("flag_hourly_spike").count()
    # The rows of a block and its surroundings, not the series, are what a window sorts.
    plan = qc.rolling_reference(hours, config, ["who"], True)._jdf.queryExecution().executedPlan().toString()
    assert all("_block" in line or "_stretch" in line for line in plan.splitlines() if "Window [" in line and "_total" not in line)
