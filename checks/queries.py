"""One registered query per operator; each reads whole tables and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroseries.config import GASES, PAIRS, REQUIRED_COLUMNS, QcConfig, ScaleLimits
from aeroseries.functions.files import delete_on_exit
from aeroseries.functions.lineage import checkpoint_dir, cut_lineage
from aeroseries.operators import correlation, diurnal, hourly, ranges, report, standardize
from aeroseries.operators import quality_control as qc
from aeroseries.plans import batch, views
from aeroseries.sources import catalog, logs, store
from aeroseries.streaming import imports
from checks.fixtures import (
    FIT_HOURS,
    GAS,
    RANGE,
    WIDE_RANGE,
    file_manifest,
    found_files,
    log_texts,
    order_readings,
    raw_rows,
    readings,
    table,
    with_copies,
    write_logs,
)

Query = Callable[[SparkSession, str], DataFrame]

DEFAULT = QcConfig()
#: The forms for hours too busy to gather and too many to broadcast.
SPREAD = ScaleLimits(rows_per_hour=1, broadcast_hours=0)
#: The form for series too long for one task.
LONG = ScaleLimits(series_hours=0)
TIGHT = QcConfig(point_spike_z=3.0, hourly_spike_z=1.5, sustained_shift_min_hours=1)
PAIR = ("co2_sync", "ch4_sync")
RATIO_PAIR = PAIRS["CH4 vs CO2/(CO+CO2)"]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zero."""
    return df.select(
        *(
            (F.round(F.col(f"`{name}`"), 6) + 0.0).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        )
    )


def on_events(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(readings(spark, sf_dir))


def on_orders(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(order_readings(spark, sf_dir))


def on_matrix(plan: Callable[[DataFrame, str], DataFrame]) -> Query:
    return on_events(lambda df: plan(diurnal.diurnal_matrix(df, GAS), GAS))


# Sources


def catalog_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = catalog.new_files(found_files(spark, sf_dir), file_manifest(spark, sf_dir))
    return fresh.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modified"), "length", "lang")


def sql_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.run_sql(
        spark,
        "SELECT date_ist, count(*) AS row_count, avg(co2_sync) AS co2_sync FROM {readings} "
        "WHERE date_ist BETWEEN :first AND :last GROUP BY date_ist",
        {"first": date.fromisoformat(RANGE[0]), "last": date.fromisoformat(RANGE[1])},
        readings=readings(spark, sf_dir),
    )


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [readings(spark, sf_dir), order_readings(spark, sf_dir)]
    return logs.union_sources(frames).select("datetime_utc", "source_file", *GASES)


# Standard readings


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.validate_rows(raw_rows(spark, sf_dir)).select("DATE", "TIME", "source_file", "line_no")


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.standardize(raw_rows(spark, sf_dir))


def dedupe_first(df: DataFrame) -> DataFrame:
    return standardize.keep_first_reading(with_copies(df)).select("datetime_utc", "source_file", *GASES)


def normalize_frame(df: DataFrame) -> DataFrame:
    loose = hourly.hourly_preaggregate(df).withColumns(
        {name: F.col(name).cast("string") for name in ("date_ist", "hour_ist", *GASES)}
    )
    return ranges.normalize_frame(loose, *RANGE).select("datetime_ist", "date_ist", "hour_ist", *GASES)


# Quality control, stage by stage


def _hours(df: DataFrame, config: QcConfig) -> tuple[DataFrame, qc.HourProfile]:
    profile = qc.hour_profile(df)
    return qc.hour_statistics(df, config, profile=profile), profile


def _scored(df: DataFrame, config: QcConfig, columns: Sequence[str]) -> DataFrame:
    hours, _ = _hours(df, config)
    return qc.score_hours(hours, config).select("gas", "hour_start_ist", *columns)


def qc_hour_stats(config: QcConfig) -> Query:
    columns = ("gas", "hour_start_ist", "hour_count", "hour_median", "hour_mad")
    return on_events(lambda df: _hours(df, config)[0].select(*columns))


def qc_hour_stats_spread(df: DataFrame) -> DataFrame:
    hours = qc.hour_statistics(df, DEFAULT, limits=SPREAD)
    return hours.select("gas", "hour_start_ist", "hour_count", "hour_median", "hour_mad")


def qc_hourly_series(config: QcConfig) -> Query:
    return on_events(lambda df: _hours(df, config)[0].select("gas", "hour_start_ist", "hour_reference"))


def qc_rolling(config: QcConfig, *columns: str) -> Query:
    return on_events(
        lambda df: qc.rolling_reference(_hours(df, config)[0], config).select("gas", "hour_start_ist", *columns)
    )


def qc_hourly_z(config: QcConfig) -> Query:
    return on_events(
        lambda df: qc.hourly_scores(qc.rolling_reference(_hours(df, config)[0], config), config).select(
            "gas", "hour_start_ist", "hourly_robust_z", "candidate"
        )
    )


def qc_run_lengths(config: QcConfig) -> Query:
    return on_events(lambda df: _scored(df, config, ["candidate", "run_length"]))


def qc_hourly_flags(config: QcConfig) -> Query:
    return on_events(lambda df: _scored(df, config, ["flag_hourly_spike", "flag_sustained_shift"]))


def qc_hard_bounds(df: DataFrame) -> DataFrame:
    return qc.hard_bounds(df).select("datetime_utc", *(f"{gas}_flag_hard" for gas in GASES))


def qc_point_spike(config: QcConfig) -> Query:
    def plan(df: DataFrame) -> DataFrame:
        hours, profile = _hours(df, config)
        small = profile.hours <= qc.ScaleLimits().broadcast_hours
        flagged = qc.flag_points(df, qc.point_scales(cut_lineage(hours), df, small=small), config, small=small)
        names = [f"{gas}_{name}" for gas in GASES for name in ("point_robust_z", "flag_point_spike")]
        return flagged.select("datetime_utc", *names)

    return on_events(plan)


def qc_flags(config: QcConfig) -> Query:
    names = [
        f"{gas}{name}"
        for gas in GASES
        for name in ("", "_flag_hourly_spike", "_flag_sustained_shift", "_hourly_robust_z", "_qc_excluded")
    ]
    return on_events(lambda df: qc.apply_quality_control(df, config).select("datetime_utc", *names))


def qc_any_flags(config: QcConfig) -> Query:
    names = ("qc_any_excluded", "qc_any_sustained_shift")
    return on_events(lambda df: qc.apply_quality_control(df, config).select("datetime_utc", *names))


def quality_control(config: QcConfig) -> Query:
    return on_events(lambda df: qc.apply_quality_control(df, config))


def quality_control_spread(df: DataFrame) -> DataFrame:
    return qc.apply_quality_control(df, TIGHT, limits=SPREAD)


def hourly_by_source(df: DataFrame) -> DataFrame:
    return hourly.hourly_preaggregate(df, ["source_file"])


def quality_report(df: DataFrame) -> DataFrame:
    return report.quality_report(qc.apply_quality_control(df, TIGHT))


def process_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.process_batch(raw_rows(spark, sf_dir))


# Instruments: the event type tells them apart

BY = ("source_file",)


def quality_control_by_source(df: DataFrame) -> DataFrame:
    return qc.apply_quality_control(df, TIGHT, BY)


def by_source_view(name: str, part: str) -> Query:
    view = getattr(views, f"{name}_view")
    return on_events(lambda df: getattr(view(df, GAS, by=BY), part))


def qc_degenerate(df: DataFrame) -> DataFrame:
    """No CO that is valid, and CH4 that is always missing."""
    broken = df.withColumns({"co_sync_raw": F.lit(-1.0), "ch4_sync_raw": F.lit(None).cast("double")})
    return qc.apply_quality_control(broken, TIGHT)


# Logs and imports


def scratch_folder(spark: SparkSession, kind: str) -> str:
    folder = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    return folder


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.data_rows(logs.whole_file_rows(log_texts(spark, sf_dir)))
    return rows.select("source_file", F.col("line_no").cast("long").alias("line_no"), *REQUIRED_COLUMNS)


def log_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which logs can be read."""
    texts = log_texts(spark, sf_dir)
    files, lines = texts.select("path"), logs.whole_file_rows(texts)
    good = logs.readable_files(files, lines).withColumn("readable", F.lit(True))
    return good.unionByName(logs.rejected_files(files, lines).withColumn("readable", F.lit(False)))


def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below each instrument's folder."""
    folder = scratch_folder(spark, "logs")
    write_logs(spark, sf_dir, folder)
    stations = [row[0] for row in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    roots = [f"{folder}/half={half}/station={station}" for half in ("odd", "even") for station in stations]
    name = F.regexp_extract("folder", r"half=(\w+)/station=(\w+)", 0)
    return logs.count_files(spark, roots).select(name.alias("folder"), "files")


def imported(spark: SparkSession, sf_dir: str, parts: Sequence[str]) -> store.GasStore:
    """Log files brought in part by part into a store with four buckets of instruments."""
    folder = scratch_folder(spark, "logs")
    write_logs(spark, sf_dir, folder)
    target = store.GasStore(spark, scratch_folder(spark, "store"), series_buckets=4)
    manifest = catalog.Manifest(spark, scratch_folder(spark, "manifest"))
    for part in parts:
        imports.import_folders(target, manifest, [f"{folder}/{part}"], TIGHT, series_pattern=r"station=(\w+)/")
    return target


def import_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd days first, then those in between."""
    return imported(spark, sf_dir, ["half=odd", "half=even"]).raw().drop("source_file", "series_bucket")


def import_hourly_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the hourly means of an imported store, by a date alone."""
    return imported(spark, sf_dir, [""]).query(
        "SELECT series_id, hour_start_ist, co_sync, co2_sync, ch4_sync FROM readings_hourly WHERE date_ist BETWEEN :first AND :last",
        {"first": date.fromisoformat(RANGE[0]), "last": date.fromisoformat(RANGE[1])},
    )


def load_for_views(built: bool) -> Query:
    """The range of a ratio's gases from a store, by its hourly means or without them."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = store.GasStore(spark, scratch_folder(spark, "store"))
        target.save_batch(readings(spark, sf_dir).withColumn("qc_version", F.lit("none")))
        if built:
            target.rebuild_hourly()
        return target.load_for_views(*RANGE, ["co2_over_co_plus_co2"]).select("datetime_ist", "date_ist", "hour_ist", "co_sync", "co2_sync")

    return plan


def file_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as files of each customer: those whose time overlaps another of the customer's status."""
    rows = order_readings(spark, sf_dir).select(
        F.concat_ws("-", "source_file", F.col("co_sync").cast("long")).alias("source_file"),
        F.concat_ws("-", "source_file", (F.col("co_sync") % 100).cast("long")).alias("series_id"),
        "datetime_utc",
    )
    spans = catalog.file_spans(rows)
    return catalog.overlapping_files(spans, spans)


def catalog_last_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = catalog.latest_entries(file_manifest(spark, sf_dir))
    last = file_manifest(spark, sf_dir).agg(F.max("processed_at").cast("timestamp_ntz").alias("last_import"))
    return entries.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).crossJoin(last)


# Views


def correlation_view(df: DataFrame) -> DataFrame:
    return views.correlation_view(df, "CH4 vs CO2/(CO+CO2)", *FIT_HOURS).stats


STATE = views.FilterState(
    date.fromisoformat(RANGE[1]), date.fromisoformat(RANGE[0]), "CH4 vs CO2/(CO+CO2)", *FIT_HOURS, *[GAS] * 4
)


def snapshot_summary(df: DataFrame) -> DataFrame:
    return views.snapshot(hourly.hourly_preaggregate(df).withColumn("datetime_ist", F.col("hour_start_ist")), STATE).summary


def snapshot_of(pick: Callable[[views.Snapshot], DataFrame], by: Sequence[str] = ()) -> Query:
    return on_events(lambda df: pick(views.snapshot(df, STATE, by)))


QUERIES: dict[str, Query] = {
    "catalog_new_files": catalog_new_files,
    "partition_stats": on_orders(lambda df: report.partition_stats(store.with_partition_keys(df))),
    "sql_range_query": sql_range_query,
    "union_sources": union_sources,
    "validate_rows": validate_rows,
    "standardize": standardized,
    "dedupe_first": on_events(dedupe_first),
    "load_range_raw": on_events(
        lambda df: store.select_range(store.with_partition_keys(df), *RANGE, ["date_ist", "co_sync", "co2_sync"])
    ),
    "load_range_hourly": on_events(lambda df: store.select_hourly_range(hourly.hourly_preaggregate(df), *RANGE)),
    "normalize_frame": on_events(normalize_frame),
    "filter_date_range": on_events(
        lambda df: ranges.filter_by_date_range(df, *RANGE).select("datetime_ist", "date_ist", *GASES)
    ),
    "filter_hours": on_events(
        lambda df: ranges.filter_by_hours(df, *FIT_HOURS).select("datetime_ist", "hour_ist", *GASES)
    ),
    "clamp_range": on_events(lambda df: ranges.clamp_range(df, *WIDE_RANGE)),
    "default_day": on_events(lambda df: ranges.default_day(df).select("datetime_ist", "date_ist", *GASES)),
    "gas_ratios": on_events(
        lambda df: hourly.gas_ratios(df).select("datetime_utc", "co_over_co_plus_co2", "co2_over_co_plus_co2")
    ),
    "available_months": on_orders(report.available_months),
    "summarize": on_events(report.summarize),
    "qc_hard_bounds": on_events(qc_hard_bounds),
    "qc_hour_stats": qc_hour_stats(DEFAULT),
    "qc_hour_stats_spread": on_events(qc_hour_stats_spread),
    "qc_point_spike": qc_point_spike(DEFAULT),
    "qc_point_spike_tight": qc_point_spike(TIGHT),
    "qc_hourly_series": qc_hourly_series(DEFAULT),
    "qc_hourly_series_tight": qc_hourly_series(TIGHT),
    "qc_rolling_median": qc_rolling(DEFAULT, "rolling_median"),
    "qc_rolling_median_sparse": qc_rolling(QcConfig(hourly_reference_min_periods=100), "rolling_median", "rolling_mad"),
    "qc_rolling_mad": qc_rolling(DEFAULT, "residual", "rolling_mad"),
    "qc_hourly_z": qc_hourly_z(DEFAULT),
    "qc_hourly_z_tight": qc_hourly_z(TIGHT),
    "qc_run_lengths": qc_run_lengths(DEFAULT),
    "qc_run_lengths_tight": qc_run_lengths(TIGHT),
    "qc_hourly_flags": qc_hourly_flags(DEFAULT),
    "qc_hourly_flags_tight": qc_hourly_flags(TIGHT),
    "qc_flags": qc_flags(DEFAULT),
    "qc_flags_tight": qc_flags(TIGHT),
    "qc_any_flags": qc_any_flags(DEFAULT),
    "qc_any_flags_tight": qc_any_flags(TIGHT),
    "quality_control": quality_control(DEFAULT),
    "quality_control_tight": quality_control(TIGHT),
    "quality_control_spread": on_events(quality_control_spread),
    "quality_control_long": on_events(lambda df: qc.apply_quality_control(df, TIGHT, limits=LONG)),
    "process_batch": process_batch,
    "quality_report": on_events(quality_report),
    "hourly_preaggregate": on_events(hourly.hourly_preaggregate),
    "hourly_by_source": on_events(hourly_by_source),
    "hourly_mean_filled": on_events(hourly.hourly_mean_timeseries),
    "correlation_frame": on_events(hourly.correlation_frame),
    "diurnal_long": on_events(lambda df: diurnal.diurnal_matrix(df, GAS)),
    "diurnal_pivot": on_events(lambda df: diurnal.diurnal_pivot(df, GAS)),
    "range_24_point": on_matrix(diurnal.range_24_point),
    "diurnal_stats": on_matrix(diurnal.diurnal_stats),
    "daily_mean_median": on_matrix(diurnal.daily_mean_median),
    "profile_24_all": on_events(diurnal.profile_24_point),
    "monthly_diurnal": on_orders(lambda df: views.monthly_diurnal_series(df, GAS)),
    "monthly_diurnal_all": on_orders(diurnal.monthly_diurnal_all),
    "month_hour_day": on_orders(lambda df: diurnal.month_hour_day(df, GAS)),
    "month_hour_day_matrix": on_orders(lambda df: diurnal.month_hour_day_matrix(df, GAS)),
    "pair_stats": on_events(lambda df: correlation.pair_stats(hourly.correlation_frame(df), *PAIR)),
    "pair_stats_ratio": on_events(lambda df: correlation.pair_stats(hourly.correlation_frame(df), *RATIO_PAIR)),
    "correlation_summary": on_events(correlation.correlation_summary),
    "correlation_monthly": on_orders(correlation.monthly_correlation_summary),
    "correlation_view": on_events(correlation_view),
    "scatter_points": on_events(
        lambda df: views.correlation_view(df, "CH4 vs CO2/(CO+CO2)", *FIT_HOURS).points
    ),
    "fit_line": on_events(lambda df: views.correlation_view(df, "CH4 vs CO2", *FIT_HOURS).line),
    "diurnal_summary": on_events(lambda df: views.diurnal_view(df, GAS).summary),
    "daily_bars": on_events(lambda df: views.daily_view(df, GAS).table),
    "daily_summary": on_events(lambda df: views.daily_view(df, GAS).summary),
    "hourly_series": on_events(lambda df: views.hourly_view(df, GAS).table),
    "hourly_summary": on_events(lambda df: views.hourly_view(df, GAS).summary),
    "heatmap_cells": on_events(lambda df: views.heatmap_view(df, GAS).table),
    "heatmap_summary": on_events(lambda df: views.heatmap_view(df, GAS).summary),
    "profile_series": on_events(views.profile_series),
    "quality_control_by_source": on_events(quality_control_by_source),
    "quality_report_by_source": on_events(lambda df: report.quality_report(quality_control_by_source(df), BY)),
    "qc_degenerate": on_events(qc_degenerate),
    "hourly_filled_by_source": on_events(lambda df: hourly.hourly_mean_timeseries(df, by=BY)),
    "correlation_by_source": on_events(
        lambda df: views.correlation_view(df, "CH4 vs CO2", *FIT_HOURS, by=BY).stats.drop("fit_label")
    ),
    "fit_line_by_source": on_events(lambda df: views.correlation_view(df, "CH4 vs CO2", *FIT_HOURS, by=BY).line),
    "diurnal_by_source": by_source_view("diurnal", "table"),
    "diurnal_summary_by_source": by_source_view("diurnal", "summary"),
    "daily_by_source": by_source_view("daily", "table"),
    "daily_summary_by_source": by_source_view("daily", "summary"),
    "hourly_summary_by_source": by_source_view("hourly", "summary"),
    "heatmap_summary_by_source": by_source_view("heatmap", "summary"),
    "profile_by_source": on_events(lambda df: views.profile_series(df, BY)),
    "monthly_diurnal_by_source": on_orders(lambda df: views.monthly_diurnal_series(df, GAS, BY)),
    "correlation_monthly_by_source": on_orders(lambda df: correlation.monthly_correlation_summary(df, BY)),
    "available_months_by_source": on_orders(lambda df: report.available_months(df, BY)),
    "snapshot_correlation": snapshot_of(lambda shot: shot.views["correlation"].stats.drop("fit_label")),
    "snapshot_diurnal": snapshot_of(lambda shot: shot.views["diurnal"].table),
    "snapshot_daily": snapshot_of(lambda shot: shot.views["daily"].table),
    "snapshot_hourly": snapshot_of(lambda shot: shot.views["hourly"].table),
    "snapshot_heatmap": snapshot_of(lambda shot: shot.views["heatmap"].summary),
    "snapshot_daily_by_source": snapshot_of(lambda shot: shot.views["daily"].table, BY),
    "log_rows": log_rows,
    "log_headers": log_headers,
    "log_counts": log_counts,
    "import_store": import_store,
    "import_hourly_sql": import_hourly_sql,
    "load_views_raw": load_for_views(False),
    "load_views_hourly": load_for_views(True),
    "file_overlaps": file_overlaps,
    "catalog_last_import": catalog_last_import,
    "snapshot_summary": on_events(snapshot_summary),
}


def queries() -> dict[str, Query]:
    def with_rounding(query: Query) -> Query:
        return lambda spark, sf_dir: rounded(query(spark, sf_dir))

    return {name: with_rounding(query) for name, query in QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text rows through quality control to the diurnal profile of hourly means."""
    clean = process_batch(spark, sf_dir)
    hours = hourly.hourly_preaggregate(clean)
    return rounded(views.diurnal_view(hours, GAS).table)
