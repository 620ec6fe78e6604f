"""From raw text rows to IST-aligned readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroseries.config import GASES, INSTRUMENT_COLUMNS, REQUIRED_COLUMNS
from aeroseries.functions.clock import calendar, utc_to_ist
from aeroseries.functions.numbers import to_number
from aeroseries.schema import STANDARD_COLUMNS, require_columns

#: What a regular expression calls white space; taken off the ends of every text, where an expression would cost more than the rest.
WHITE_SPACE = " \t\n\x0b\f\r"


def validate_rows(raw: DataFrame) -> DataFrame:
    """Strip white space around text columns; keep rows whose DATE and TIME begin like a date and a time."""
    require_columns(raw, REQUIRED_COLUMNS)
    text = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    trimmed = raw.withColumns({name: F.trim(F.col(name), F.lit(WHITE_SPACE)) for name in text})
    return trimmed.where(
        F.col("DATE").rlike(r"^\d{4}-\d{2}-\d{2}") & F.col("TIME").rlike(r"^\d{2}:\d{2}:\d{2}")
    )


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order.

    Spark keeps only the best row per key and task before the shuffle, so a key with many copies stays cheap.
    """
    ranked = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", ranked).where(F.col("_rank") == 1).drop("_rank")


def keep_first_reading(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One reading per UTC timestamp: from the first file, and its first line where line numbers are known."""
    if "line_no" in df.columns:
        rest = ["line_no"]
    else:
        rest = [c for c in (*(f"{gas}_raw" for gas in GASES), *GASES) if c in df.columns]
    return keep_first(df, [*by, "datetime_utc"], ["source_file", *rest])


def _typed(raw: DataFrame, by: Sequence[str]) -> DataFrame:
    """Validated rows with what cannot be derived: the timestamp, the values, and where they come from."""
    valid = validate_rows(raw).withColumnsRenamed(INSTRUMENT_COLUMNS)
    stamp = F.concat_ws(" ", "DATE", "TIME").try_cast("timestamp_ntz")
    line_no = ["line_no"] if "line_no" in raw.columns else []
    values = (to_number(F.col(gas)).alias(f"{gas}_raw") for gas in GASES)
    typed = valid.select(stamp.alias("datetime_utc"), *values, "source_file", *by, *line_no)
    return typed.where(F.col("datetime_utc").isNotNull())


def derive_columns(typed: DataFrame) -> DataFrame:
    """Add Indian time, its calendar, and the columns that will hold the clean values."""
    typed = typed.withColumn("datetime_ist", utc_to_ist(F.col("datetime_utc")))
    return typed.withColumns({**calendar(F.col("datetime_ist")), **{gas: F.col(f"{gas}_raw") for gas in GASES}})


def parse_readings(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Validated, typed and shifted to IST, before removal of duplicate timestamps."""
    line_no = ["line_no"] if "line_no" in raw.columns else []
    return derive_columns(_typed(raw, by)).select(*STANDARD_COLUMNS, *by, *line_no)


def standardize(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Standard readings with one row per timestamp (and per ``by`` key, when instruments are mixed).

    Duplicates go before the calendar is derived, so that only what was read passes through the shuffle.
    """
    return derive_columns(keep_first_reading(_typed(raw, by), by)).select(*STANDARD_COLUMNS, *by)
