"""Whole runs: process a batch, run everything on a folder of month files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from aeroseries.config import GASES, QcConfig, ScaleLimits
from aeroseries.functions.lineage import stage_table, staged
from aeroseries.operators.diurnal import monthly_diurnal_all
from aeroseries.operators.hourly import hourly_mean_timeseries
from aeroseries.operators.quality_control import apply_quality_control
from aeroseries.operators.report import quality_report
from aeroseries.operators.standardize import standardize
from aeroseries.sources.logs import load_all
from aeroseries.sources.store import GasStore, with_partition_keys, write_table


def process_batch(
    raw: DataFrame,
    config: QcConfig = QcConfig(),
    by: Sequence[str] = (),
    limits: ScaleLimits = ScaleLimits(),
) -> DataFrame:
    """Raw rows to quality-controlled readings with partition keys.

    Parsed readings are staged once: quality control scans them several times, a few columns each.
    """
    readings = stage_table(standardize(raw, by))
    return with_partition_keys(apply_quality_control(readings, config, by, limits))


def save_reports(clean: DataFrame, out_data: str, out_logs: str) -> None:
    """Quality report, hourly means, and monthly diurnal means of each gas as CSV."""
    write_table(quality_report(clean), f"{out_logs}/qa_report.csv")
    write_table(
        hourly_mean_timeseries(clean).orderBy("hour_start_ist"), f"{out_data}/hourly_mean_ist.csv"
    )
    with staged(monthly_diurnal_all(clean)) as monthly:
        for gas in GASES:
            own = monthly.select("month_ist", "hour_ist", gas).orderBy("month_ist", "hour_ist")
            write_table(own, f"{out_data}/monthly_diurnal_24point_{gas}.csv")


def run(
    spark: SparkSession,
    data_root: str,
    out_data: str,
    out_logs: str,
    month_dirs: Iterable[str] | None = None,
    config: QcConfig = QcConfig(),
) -> GasStore:
    """Load month files, process and store them, write the reports, build the hourly means."""
    store = GasStore(spark, out_data)
    with staged(standardize(load_all(spark, data_root, month_dirs))) as readings:
        store.save_batch(apply_quality_control(readings, config))
    save_reports(store.raw(), out_data, out_logs)
    store.rebuild_hourly()
    return store
