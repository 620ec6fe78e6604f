"""Small frames made by hand, and the SQL chain run on them."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroseries.config import GASES
from aeroseries.functions.clock import calendar, utc_to_ist
from aeroseries.schema import QC_COLUMNS, STANDARD_COLUMNS
from checks.oracles import CALENDAR, CLEANED, qc_chain, wide_qc, with_

READING = T.StructType(
    [
        T.StructField("datetime_utc", T.TimestampNTZType()),
        *(T.StructField(f"{gas}_raw", T.DoubleType()) for gas in GASES),
        T.StructField("source_file", T.StringType()),
    ]
)
START = datetime(2025, 10, 31, 18, 30)  # midnight in India


def make_readings(spark, rows):
    """Standard readings from (utc, co, co2, ch4[, source_file]) tuples."""
    full = [(*row, "a.dat") if len(row) == 4 else row for row in rows]
    df = spark.createDataFrame(full, READING).withColumn("datetime_ist", utc_to_ist(F.col("datetime_utc")))
    df = df.withColumns({**calendar(F.col("datetime_ist")), **{gas: F.col(f"{gas}_raw") for gas in GASES}})
    return df.select(*STANDARD_COLUMNS)


def hourly_rows(values_by_hour, step=timedelta(minutes=1)):
    """Rows with the same value for all gases, the n-th list holding the n-th hour's values."""
    rows = []
    for hour, values in enumerate(values_by_hour):
        for i, value in enumerate(values):
            at = START + timedelta(hours=hour) + i * step
            rows.append((at, value, value, value))
    return rows


def expected_qc(rows, config):
    """The QC columns by SQL, for the same rows."""
    names = ["datetime_utc", *(f"{gas}_raw" for gas in GASES), "source_file"]
    full = [(*row, "a.dat") if len(row) == 4 else row for row in rows]
    given = pd.DataFrame(full, columns=names).astype({f"{gas}_raw": float for gas in GASES})  # noqa: F841
    connection = duckdb.connect()
    base = f"""
base AS (
  SELECT datetime_utc, datetime_utc + INTERVAL '5 hours 30 minutes' AS datetime_ist, source_file,
         {", ".join(f"CASE WHEN isnan({gas}_raw) THEN NULL ELSE {gas}_raw END AS {gas}_raw" for gas in GASES)}
  FROM given),
readings AS (SELECT *, {CLEANED}, {CALENDAR} FROM base)"""
    sql = with_(base, qc_chain(config), wide_qc()) + f"SELECT {', '.join(QC_COLUMNS)} FROM clean ORDER BY datetime_utc"
    return [_plain(row) for row in connection.execute(sql).fetchall()]


def actual_qc(df):
    return [_plain(tuple(row)) for row in df.select(*QC_COLUMNS).orderBy("datetime_utc").collect()]


def _plain(row):
    return tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
