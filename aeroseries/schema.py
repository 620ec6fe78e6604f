"""Column layouts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aeroseries.config import GASES, REQUIRED_COLUMNS

RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in REQUIRED_COLUMNS]
    + [T.StructField("source_file", T.StringType()), T.StructField("line_no", T.LongType())]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("first_utc", T.TimestampNTZType()),
        T.StructField("last_utc", T.TimestampNTZType()),
        T.StructField("rows", T.LongType()),
    ]
)

#: The instrument of readings that name none.
DEFAULT_SERIES = "default"

CALENDAR_COLUMNS = (
    "datetime_utc",
    "datetime_ist",
    "hour_start_ist",
    "date_ist",
    "hour_ist",
    "day_ist",
    "month_ist",
)

STANDARD_COLUMNS = (
    *CALENDAR_COLUMNS,
    *(f"{gas}_raw" for gas in GASES),
    *GASES,
    "source_file",
)

QC_COLUMNS = (
    *CALENDAR_COLUMNS,
    "source_file",
    "qc_version",
    *(
        name
        for gas in GASES
        for name in (
            f"{gas}_raw",
            gas,
            f"{gas}_flag_hard",
            f"{gas}_flag_point_spike",
            f"{gas}_flag_hourly_spike",
            f"{gas}_flag_sustained_shift",
            f"{gas}_qc_excluded",
            f"{gas}_point_robust_z",
            f"{gas}_hourly_robust_z",
        )
    ),
    "qc_any_excluded",
    "qc_any_sustained_shift",
)


#: What a file says of one timestamp, before it is known which file counts.
CANDIDATE_COLUMNS = ("series_id", "datetime_utc", *(f"{gas}_raw" for gas in GASES), "source_file")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def present_gases(df: DataFrame) -> list[str]:
    return [gas for gas in GASES if gas in df.columns]
