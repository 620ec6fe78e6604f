"""The given tables read as gas readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroseries.config import GASES
from aeroseries.functions.clock import calendar, utc_to_ist
from aeroseries.schema import STANDARD_COLUMNS

RANGE = ("2024-01-05", "2024-01-20")
WIDE_RANGE = ("2024-02-15", "2023-12-01")
GAS = "co2_sync"
FIT_HOURS = (18, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reading_columns(utc: Column, source: Column, co: Column, co2: Column, ch4: Column) -> dict[str, Column]:
    ist = utc_to_ist(utc)
    raw = dict(zip(GASES, (co, co2, ch4), strict=True))
    return {
        "datetime_utc": utc,
        "datetime_ist": ist,
        **calendar(ist),
        **{f"{gas}_raw": value for gas, value in raw.items()},
        **raw,
        "source_file": source,
    }


def _as_readings(df: DataFrame, *columns: Column) -> DataFrame:
    named = _reading_columns(*columns)
    return df.select(*(named[name].alias(name) for name in STANDARD_COLUMNS))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard readings from ``events``: one month, missing CO, negative CH4."""
    return _as_readings(
        table(spark, sf_dir, "events"),
        F.col("ts"),
        F.col("event_type"),
        F.when(F.col("event_type") != "error", F.col("value")),
        400.0 + F.get_json_object("props", "$.k").cast("double"),
        F.col("value") - 1.0,
    )


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard readings from ``orders``: many months, repeated timestamps."""
    hour = (F.col("o_orderkey") % 24).cast("int")
    return _as_readings(
        table(spark, sf_dir, "orders"),
        F.timestamp_add("HOUR", hour, F.col("o_orderdate").cast("timestamp_ntz")),
        F.col("o_orderstatus"),
        F.col("o_custkey").cast("double"),
        F.col("o_totalprice"),
        F.col("o_totalprice") / 100.0 + F.col("o_custkey"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as a log file would give them, from ``events``."""
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "signup", F.date_format("ts", "dd/MM/yyyy"))
        .when(kind == "view", F.concat(F.lit("  "), day, F.lit(" ")))
        .otherwise(day)
        .alias("DATE"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("TIME"),
        F.when(kind == "error", F.lit("bad")).otherwise(F.col("value").cast("string")).alias("CO_sync"),
        (400.0 + F.get_json_object("props", "$.k").cast("double")).cast("string").alias("CO2_sync"),
        (F.col("value") - 1.0).cast("string").alias("CH4_sync"),
        kind.alias("source_file"),
        F.col("event_id").alias("line_no"),
    )


def with_copies(df: DataFrame) -> DataFrame:
    """Each reading twice more: once from a file sorted before its own, once from one after it."""
    changed = {gas: F.col(gas) + 1.0 for gas in GASES}
    early = df.where(F.col("source_file") == "view").withColumns({**changed, "source_file": F.lit("a_view")})
    late = df.withColumns({**changed, "source_file": F.concat(F.lit("z_"), "source_file")})
    return df.unionByName(early).unionByName(late)


def found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` seen as a listing of files."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias(
            "modificationTime"
        ),
        F.col("n_chars").alias("length"),
        "lang",
    )


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was imported before: nothing in French, German files of another size, Spanish ones imported twice."""
    found = found_files(spark, sf_dir).where(F.col("lang") != "fr")
    first = F.lit("2024-06-01 00:00:00").cast("timestamp")
    second = F.lit("2024-07-01 00:00:00").cast("timestamp")
    grown = F.col("length") + F.when(F.col("lang") == "de", 1).otherwise(0)
    entries = found.withColumns({"length": grown, "processed_at": first})
    again = found.where(F.col("lang") == "es").withColumns(
        {"length": F.col("length") + F.length("path") - 6, "processed_at": second}
    )
    return entries.unionByName(again).drop("lang")


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as lines of clean logs: the event type is the instrument, each day has a log of its own."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        kind.alias("station"),
        F.date_format("ts", "yyyy-MM-dd").alias("DATE"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("TIME"),
        F.when(kind == "error", F.lit("bad")).otherwise(F.col("value").cast("string")).alias("CO_sync"),
        (400.0 + F.get_json_object("props", "$.k").cast("double")).cast("string").alias("CO2_sync"),
        (F.col("value") - 1.0).cast("string").alias("CH4_sync"),
    )


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value): the text of each log; its form depends on the instrument, those of ``signup`` lack a column."""
    station, names = F.col("station"), ["DATE", "TIME", "CO_sync", "CO2_sync", "CH4_sync"]
    comma = station == "purchase"
    line = F.when(comma, F.concat_ws(",", *names)).otherwise(F.concat_ws("  ", *names))
    rows = log_rows(spark, sf_dir).select("station", "DATE", F.struct("TIME", line.alias("line")).alias("row"))
    logs = rows.groupBy("station", "DATE").agg(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["line"]).alias("lines"))
    head = " ".join(names)
    header = (
        F.when(comma, F.lit(",".join(names)))
        .when(station == "signup", F.lit(" ".join(names[:-1])))
        .when(station == "view", F.lit(f"a note\n\n{head.lower()}"))
        .otherwise(F.lit(head))
    )
    end = F.when(station == "error", F.lit("\r\n")).otherwise(F.lit("\n"))
    text = F.array_join(F.concat(F.array(header), F.col("lines")), "\n")
    return logs.select(F.concat_ws("/", "station", "DATE").alias("path"), F.replace(text, F.lit("\n"), end).alias("value"))


def write_logs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Log files below ``<folder>/odd`` and ``<folder>/even``, by day of month, instrument and date."""
    odd = F.when(F.substring("DATE", 9, 2).cast("int") % 2 == 1, F.lit("odd")).otherwise(F.lit("even"))
    rows = log_rows(spark, sf_dir).withColumns({"half": odd, "day": F.col("DATE")})
    writer = rows.repartition("half", "station", "day").write.partitionBy("half", "station", "day")
    writer.option("header", True).option("sep", " ").option("extension", "dat").csv(folder)
