"""The store: readings by month and bucket of instruments, what files said, and the hourly tables behind the flags, all as Parquet.

A cell is a year, a month and a bucket of instruments. Every table is laid out by cells, so a batch of files replaces the
cells it touches, one instrument opens one bucket, and a cell of many readings is several files while small instruments share one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroseries.config import GASES, ScaleLimits
from aeroseries.functions.clock import as_date, in_months
from aeroseries.functions.files import any_path, child_names, delete, matching, path_exists, read_text, write_text
from aeroseries.operators.hourly import columns_for, hourly_preaggregate
from aeroseries.operators.ranges import filter_by_date_range, normalize_frame
from aeroseries.operators.report import available_months, partition_stats, summarize
from aeroseries.schema import CANDIDATE_COLUMNS, DEFAULT_SERIES

HOURLY_COLUMNS = ("hour_start_ist", "date_ist", "hour_ist", *GASES)
CELL = ("year", "month", "series_bucket")


class Cell(NamedTuple):
    """What is read and replaced as a whole."""

    year: int
    month: int
    series_bucket: int = 0


def with_partition_keys(df: DataFrame) -> DataFrame:
    """Add IST ``year`` and ``month``."""
    return df.withColumns({"year": F.year("datetime_ist"), "month": F.month("datetime_ist")})


def series_bucket(series: Column, buckets: int) -> Column:
    """The bucket of an instrument."""
    return F.pmod(F.xxhash64(series), F.lit(buckets)).cast("int")


def is_any_cell(cells: Iterable[Cell], buckets: int) -> Column:
    """Partition predicate for a list of cells."""
    number = (F.col("year") * 12 + F.col("month")) * buckets + F.col("series_bucket")
    return number.isin([(c.year * 12 + c.month) * buckets + c.series_bucket for c in cells])


def distinct_cells(df: DataFrame) -> set[Cell]:
    """The cells of some rows; their number is bounded by the calendar and the buckets."""
    return {Cell(*row) for row in df.select(*CELL).distinct().collect()}


def select_range(df: DataFrame, start: date | str, end: date | str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of stored readings for a date range, in time order.

    The range is also stated on the partition columns: a predicate on ``date_ist`` alone would open every month.
    """
    start, end = as_date(start), as_date(end)
    names = list(dict.fromkeys(["datetime_ist", *columns] if "datetime_ist" not in columns else columns))
    pruned = df.where(in_months(start, end)) if {"year", "month"} <= set(df.columns) else df
    return filter_by_date_range(pruned, start, end).select(*names).orderBy("datetime_ist")


def select_hourly_range(df: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Hourly means for a date range, in time order."""
    start, end = as_date(start), as_date(end)
    pruned = df.where(F.col("year").between(start.year, end.year)) if "year" in df.columns else df
    return filter_by_date_range(pruned, start, end).select(*HOURLY_COLUMNS).orderBy("hour_start_ist")


def run_sql(
    spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **frames: DataFrame
) -> DataFrame:
    """Parameterized SQL; ``{name}`` in the text stands for a frame, ``:name`` for an argument. Errors are raised."""
    return spark.sql(sql, args=dict(args or {}), **frames)


class GasStore:
    """Tables below ``root``: ``db`` (quality-controlled readings), ``db_files`` (every file's readings, also those that
    another file's take the place of), ``db_hour_statistics`` and ``db_hour_scores`` (what the flags rest on),
    ``db_hourly`` (hourly means).

    ``series_buckets`` is chosen when a store is made and kept with it: more of them for many instruments.
    """

    def __init__(
        self, spark: SparkSession, root: str, limits: ScaleLimits = ScaleLimits(), series_buckets: int | None = None
    ) -> None:
        self.spark = spark
        self.raw_path = f"{root}/db"
        self.files_path = f"{root}/db_files"
        self.statistics_path = f"{root}/db_hour_statistics"
        self.scores_path = f"{root}/db_hour_scores"
        self.hourly_path = f"{root}/db_hourly"
        self.limits = limits
        self._layout_path = f"{root}/layout.json"
        known = read_text(spark, self._layout_path)
        self.series_buckets = json.loads(known)["series_buckets"] if known else series_buckets or 1
        if series_buckets not in (None, self.series_buckets):
            raise ValueError(f"the store under {root} has {self.series_buckets} series buckets")
        self._layout_is_known = known is not None

    # Reading

    def _exists(self, path: str) -> bool:
        return any_path(self.spark, f"{path}/year=*")

    def raw_exists(self) -> bool:
        return self._exists(self.raw_path)

    def hourly_exists(self) -> bool:
        return self._hourly_version() is not None

    def _hourly_version(self) -> str | None:
        """The folder of the latest whole version of the hourly means."""
        versions = [name for name in child_names(self.spark, self.hourly_path) if name.startswith("version=")]
        whole = (v for v in sorted(versions, reverse=True) if path_exists(self.spark, f"{self.hourly_path}/{v}/_SUCCESS"))
        return next(whole, None)

    def raw(self) -> DataFrame:
        return self.spark.read.parquet(self.raw_path)

    def hourly(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.hourly_path}/{self._hourly_version()}")

    def cells_of(self, path: str) -> set[Cell]:
        """The cells that a table holds, from its folders alone."""
        folders = matching(self.spark, f"{path}/year=*/month=*/series_bucket=*")
        return {Cell(*(int(part.split("=")[1]) for part in folder.split("/")[-3:])) for folder in folders}

    def in_cells(self, path: str, cells: Iterable[Cell]) -> DataFrame | None:
        """A table's rows in some cells; None where it holds none of them."""
        wanted = set(cells) & self.cells_of(path)
        if not wanted:
            return None
        return self.spark.read.parquet(path).where(is_any_cell(sorted(wanted), self.series_buckets))

    def candidates(self, cells: Iterable[Cell]) -> DataFrame | None:
        """What all files say of some cells; readings saved without their files count as said by the file they name."""
        cells = set(cells)
        known = cells & self.cells_of(self.files_path)
        parts = [self.in_cells(self.files_path, known), self.in_cells(self.raw_path, cells - known)]
        frames = [part.select(*CANDIDATE_COLUMNS, *CELL) for part in parts if part is not None]
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1]) if frames else None

    def register_views(self) -> None:
        """``readings`` and ``readings_hourly``; each only once its data exists."""
        if self.raw_exists():
            self._by_day(self.raw(), self.raw_path).createOrReplaceTempView("readings")
        if self.hourly_exists():
            path = f"{self.hourly_path}/{self._hourly_version()}"
            self._by_day(self.hourly(), path).createOrReplaceTempView("readings_hourly")

    def _by_day(self, df: DataFrame, path: str) -> DataFrame:
        """A stored table joined with the days of its months.

        SQL that names ``date_ist`` alone filters the few days as well, and by them Spark opens their months only. Rows
        without a date have no month either, so none are stored.
        """
        months = sorted({(c.year, c.month) for c in self.cells_of(path)})
        starts = self.spark.createDataFrame(months, "year int, month int").withColumn("first", F.make_date("year", "month", F.lit(1)))
        days = starts.select("year", "month", F.explode(F.sequence("first", F.last_day("first"))).alias("date_ist"))
        return df.join(F.broadcast(days), ["year", "month", "date_ist"]).select(*df.columns)

    def query(self, sql: str, args: Mapping[str, object] | None = None) -> DataFrame:
        """Parameterized SQL over the views."""
        self.register_views()
        return run_sql(self.spark, sql, args)

    def _of_series(self, df: DataFrame, series: str | None) -> DataFrame:
        """Rows of one instrument; its bucket is named too, so that no other is opened."""
        if series is None:
            return df
        mine = series_bucket(F.lit(series), self.series_buckets)
        return df.where((F.col("series_bucket") == mine) & (F.col("series_id") == series))

    def load_range(
        self, start: date | str, end: date | str, columns: Sequence[str], series: str | None = None
    ) -> DataFrame:
        return select_range(self._of_series(self.raw(), series), start, end, columns)

    def load_hourly_range(self, start: date | str, end: date | str, series: str | None = None) -> DataFrame:
        return select_hourly_range(self._of_series(self.hourly(), series), start, end)

    def load_for_views(
        self, start: date | str, end: date | str, columns: Sequence[str] | None = None, series: str | None = None
    ) -> DataFrame:
        """Hourly means where they exist, readings otherwise, in the form the views take.

        ``columns`` are gases or ratios to be shown; what they need is loaded.
        """
        needed = columns_for(*(columns or GASES))
        if self.hourly_exists():
            hours = normalize_frame(self.load_hourly_range(start, end, series), start, end)
            return hours.select(*(name for name in hours.columns if name in needed))
        return normalize_frame(self.load_range(start, end, needed, series), start, end)

    def summarize(self) -> DataFrame:
        return summarize(self.raw())

    def available_months(self) -> DataFrame:
        return available_months(self.raw())

    def partition_stats(self) -> DataFrame:
        return partition_stats(self.raw())

    # Writing

    def with_cells(self, df: DataFrame) -> DataFrame:
        """Add the cell of each row, and the default instrument where none is named."""
        if "series_id" not in df.columns:
            df = df.withColumn("series_id", F.lit(DEFAULT_SERIES))
        if not {"year", "month"} <= set(df.columns):
            df = with_partition_keys(df)
        return df.withColumn("series_bucket", series_bucket(F.col("series_id"), self.series_buckets))

    def _write_cells(self, df: DataFrame, path: str, mode: str, *order: str) -> None:
        """Write by cell, in files of Spark's advisory size, each by instrument and in time order.

        The rebalance hint lets adaptive execution split a cell that holds most of the data and join small ones.
        """
        if not self._layout_is_known:
            write_text(self.spark, self._layout_path, json.dumps({"series_buckets": self.series_buckets}))
            self._layout_is_known = True
        spread = df.hint("rebalance", *CELL).sortWithinPartitions(*CELL, "series_id", *order)
        writer = spread.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*CELL).parquet(path)

    def save_batch(self, df: DataFrame) -> None:
        """Append a batch of quality-controlled readings.

        What the hourly tables say of its cells no longer holds; the next import works it out again.
        """
        df = self.with_cells(df)
        self._write_cells(df, self.raw_path, "append", "datetime_ist")
        if self._exists(self.files_path):
            cells = distinct_cells(df)
            known = cells & self.cells_of(self.files_path)
            said = df.where(is_any_cell(sorted(known), self.series_buckets)).select(*CANDIDATE_COLUMNS, *CELL)
            self._write_cells(said, self.files_path, "append", "datetime_utc")
            self.drop_cells(self.statistics_path, cells)

    def replace_cells(self, df: DataFrame, path: str, without_rows: Iterable[Cell], *order: str) -> None:
        """Write whole cells in place of what is stored for them, and remove those that no row is left for."""
        self._write_cells(df, path, "overwrite", *order)
        self.drop_cells(path, without_rows)

    def drop_cells(self, path: str, cells: Iterable[Cell]) -> None:
        for cell in cells:
            delete(self.spark, f"{path}/year={cell.year}/month={cell.month}/series_bucket={cell.series_bucket}")

    def drop_months(self, months: Iterable[tuple[int, int]]) -> None:
        """Remove the readings of whole months."""
        months = set(months)
        for path in (self.raw_path, self.files_path, self.statistics_path, self.scores_path):
            self.drop_cells(path, [c for c in self.cells_of(path) if (c.year, c.month) in months])

    def fragmented_cells(self) -> DataFrame:
        """Cells with more small files than their bytes call for, from a file listing alone; full files do not count."""
        files = (
            self.spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", "true")
            .load(self.raw_path)
            .select("path", "length")
        )
        named = (F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("int").alias(name) for name in CELL)
        # A file of three quarters of the aim is as good as a full one.
        small = files.where(F.col("length") < 0.75 * self.limits.target_file_bytes).select(*named, "length")
        sizes = small.groupBy(*CELL).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
        return sizes.where(F.col("files") > F.ceil(F.col("bytes") / self.limits.target_file_bytes))

    def compact(self) -> list[Cell]:
        """Rewrite fragmented cells in fewer files; returns those cells."""
        cells = sorted(Cell(*(row[name] for name in CELL)) for row in self.fragmented_cells().collect())
        if cells:
            stored = self.raw().where(is_any_cell(cells, self.series_buckets))
            self._write_cells(stored, self.raw_path, "overwrite", "datetime_ist")
        return cells

    def _hourly_means(self, readings: DataFrame) -> DataFrame:
        return self.with_cells(with_hour_keys(hourly_preaggregate(readings, ["series_id"])))

    def update_hourly(self, cells: Iterable[Cell]) -> None:
        """Bring the hourly means of some cells up to date, in the version in force."""
        cells = set(cells)
        path = f"{self.hourly_path}/{self._hourly_version()}"
        readings = self.in_cells(self.raw_path, cells)
        if readings is not None:
            self._write_cells(self._hourly_means(readings), path, "overwrite", "hour_start_ist")
        self.drop_cells(path, (cells & self.cells_of(path)) - self.cells_of(self.raw_path))

    def rebuild_hourly(self, years: Sequence[int] | None = None) -> None:
        """Recompute the hourly means, of some years or of all.

        A whole table is a version of its own, which counts once it is complete; the one before it stays for readers that
        have it open, older ones go. Years are replaced in the version in force.
        """
        before = self._hourly_version()
        if years is not None and before is not None:
            every = self.cells_of(self.raw_path) | self.cells_of(f"{self.hourly_path}/{before}")
            return self.update_hourly(cell for cell in every if cell.year in set(years))
        number = int(before.split("=")[1]) + 1 if before else 1
        spread = self._hourly_means(self.raw()).hint("rebalance", *CELL)
        spread = spread.sortWithinPartitions(*CELL, "series_id", "hour_start_ist")
        spread.write.mode("overwrite").partitionBy(*CELL).parquet(f"{self.hourly_path}/version={number:06d}")
        for name in child_names(self.spark, self.hourly_path):
            if name.startswith("version=") and name < (before or ""):
                delete(self.spark, f"{self.hourly_path}/{name}")


def with_hour_keys(hourly: DataFrame) -> DataFrame:
    return hourly.withColumns({"year": F.year("hour_start_ist"), "month": F.month("hour_start_ist")})


def write_table(df: DataFrame, path: str) -> str:
    """Write a report as Parquet or, for any other suffix, as CSV with a header."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", "true").csv(path)
    return path
