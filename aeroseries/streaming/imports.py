"""Incremental import: new log files into the store, in batches or as a stream.

What a batch leaves behind does not depend on what came before it. The store keeps what every file says, so a file that is read
again gives way to those it had displaced. Flags rest on an hourly table of the whole store that is kept up to date; where an
hour's figures move, its cell is rewritten, however long ago it was imported.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from aeroseries.config import QcConfig
from aeroseries.functions.clock import utc_to_ist
from aeroseries.functions.files import path_exists
from aeroseries.functions.lineage import scratch, stage_table, staged
from aeroseries.operators.quality_control import LOOKUP, flag_readings, hour_profile, hour_statistics, point_scales, prepare, score_hours
from aeroseries.operators.standardize import derive_columns, keep_first, parse_readings
from aeroseries.schema import CANDIDATE_COLUMNS, DEFAULT_SERIES, STANDARD_COLUMNS
from aeroseries.sources.catalog import IDENTITY, Manifest, file_spans, latest_entries, new_files
from aeroseries.sources.logs import data_rows, discover_files, read_log_lines, readable_files
from aeroseries.sources.store import CELL, Cell, GasStore, distinct_cells, is_any_cell, series_bucket

SERIES = ["series_id"]
HOUR_KEY = ["series_id", "gas", "hour_start_ist"]


@dataclass(frozen=True)
class ImportSummary:
    new_files: int
    skipped_files: int
    row_count: int
    last_sync: datetime | None


def with_series(lines: DataFrame, pattern: str | None) -> DataFrame:
    """Name the instrument of each line: the first group of a pattern found in its file's path."""
    if pattern is None:
        return lines.withColumn("series_id", F.lit(DEFAULT_SERIES))
    found = F.regexp_extract("source_file", pattern, 1)
    return lines.withColumn("series_id", F.when(found != "", found).otherwise(F.lit(DEFAULT_SERIES)))


def replaced_cells(store: GasStore, manifest: Manifest, files: DataFrame) -> set[Cell]:
    """The cells in which earlier forms of the files may have readings, from the time that each one spanned."""
    before = latest_entries(manifest.read()).join(files.select("path"), "path", "left_semi")
    first, last = (F.date_trunc("month", utc_to_ist(F.col(name))) for name in ("first_utc", "last_utc"))
    month = F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("month_start")
    months = before.where("first_utc IS NOT NULL").select("series_id", month)
    keys = F.year("month_start").alias("year"), F.month("month_start").alias("month")
    bucket = series_bucket(F.col("series_id"), store.series_buckets).alias("series_bucket")
    cells = distinct_cells(months.select(*keys, bucket))
    # Entries of an older form of the manifest do not tell: the readings are asked.
    unknown = before.where("rows IS NULL").select(F.col("path").alias("source_file"))
    if store.raw_exists() and not unknown.isEmpty():
        cells |= distinct_cells(store.raw().select("source_file", *CELL).join(unknown, "source_file", "left_semi"))
    return cells


def _moved(before: DataFrame | None, after: DataFrame) -> set[Cell]:
    """The cells of hours whose figures are not what they were."""
    if before is None:
        return distinct_cells(after)
    keys = [*HOUR_KEY, *CELL]
    old = before.select(*keys, *(F.col(name).alias(f"_{name}") for name in LOOKUP), F.lit(True).alias("_old"))
    both = after.select(*keys, *LOOKUP, F.lit(True).alias("_new")).join(old, keys, "full")
    differs = reduce(or_, (~F.col(name).eqNullSafe(F.col(f"_{name}")) for name in (*LOOKUP,)))
    return distinct_cells(both.where(differs | F.col("_old").isNull() | F.col("_new").isNull()))


def _union(frames: Iterable[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, (frame for frame in frames if frame is not None))


def file_readings(store: GasStore, lines: DataFrame, series_pattern: str | None = None) -> DataFrame:
    """What each file says of each timestamp, with its cell: of several lines with one timestamp the first."""
    parsed = parse_readings(data_rows(with_series(lines, series_pattern)), SERIES)
    own = keep_first(parsed, ["series_id", "datetime_utc", "source_file"], ["line_no"])
    return store.with_cells(own).select(*CANDIDATE_COLUMNS, *CELL)


def merge_batch(
    store: GasStore,
    incoming: DataFrame,
    sources: DataFrame,
    config: QcConfig = QcConfig(),
    replaced: Iterable[Cell] = (),
) -> set[Cell]:
    """Bring the readings of a batch of files into the store; returns the cells that changed.

    ``sources`` names the files (``source_file``), whose earlier readings go; ``replaced`` the cells where those may be.

    1. The cells that the batch touches are put together anew from what all files say of them; of several files with
       one timestamp the first by name counts.
    2. The statistics of their hours take the place of the stored ones, and the hours of their instruments are scored with all
       others. Cells where a figure differs from the stored scores are written again too.
    3. Readings and hourly means are written before the scores, and the caller records the files last. A batch that failed
       anywhere can run again and does the rest.
    """
    without = store.cells_of(store.raw_path) - store.cells_of(store.statistics_path)
    touched = distinct_cells(incoming) | set(replaced) | without
    if not touched:
        return touched
    stored = store.candidates(touched)
    kept = None if stored is None else stored.join(sources, "source_file", "left_anti")
    with staged(_union([incoming, kept])) as candidates:
        return _write_batch(store, candidates, touched, config)


def _write_batch(store: GasStore, candidates: DataFrame, touched: set[Cell], config: QcConfig) -> set[Cell]:
    present = distinct_cells(candidates)
    empty = touched - present
    winners = keep_first(candidates, ["series_id", "datetime_utc"], ["source_file"])
    columns = [*STANDARD_COLUMNS, "series_id", *CELL]
    with staged(derive_columns(winners).select(*columns)) as readings:
        prepared = prepare(readings)
        profile = hour_profile(prepared, SERIES)
        counted = hour_statistics(prepared, config, SERIES, store.limits, profile)
        buckets = {cell.series_bucket for cell in touched}
        others = {cell for cell in store.cells_of(store.statistics_path) if cell.series_bucket in buckets} - touched
        with staged(_with_hour_cells(store, counted)) as statistics:
            hours = _union([statistics, store.in_cells(store.statistics_path, others)])
            rest = store.in_cells(store.raw_path, others)
            everything = prepare(_union([readings, None if rest is None else rest.select(*columns)]))
            scaled = point_scales(hours, everything, SERIES)
            # One row per hour and gas.
            n_hours = hours.count() // 3
            scored = score_hours(scaled, config, SERIES, n_hours > store.limits.series_hours).select(*HOUR_KEY, *LOOKUP, *CELL)
            with staged(scored) as scores:
                known = {cell for cell in store.cells_of(store.scores_path) if cell.series_bucket in buckets}
                changed = _moved(store.in_cells(store.scores_path, known), scores) | touched
                rest = store.in_cells(store.raw_path, changed - touched)
                rewritten = prepare(_union([readings, None if rest is None else rest.select(*columns)]))
                small = n_hours <= store.limits.broadcast_hours
                clean = flag_readings(rewritten, scores.drop(*CELL), config, SERIES, small)
                store.replace_cells(candidates, store.files_path, empty, "datetime_utc")
                store.replace_cells(clean, store.raw_path, empty, "datetime_ist")
                store.replace_cells(statistics, store.statistics_path, empty, "gas", "hour_start_ist")
                if store.hourly_exists():
                    store.update_hourly(changed)
                moved = scores.where(is_any_cell(sorted(changed), store.series_buckets))
                store.replace_cells(moved, store.scores_path, empty, "gas", "hour_start_ist")
    return changed


def _with_hour_cells(store: GasStore, hours: DataFrame) -> DataFrame:
    keyed = hours.withColumns({"year": F.year("hour_start_ist"), "month": F.month("hour_start_ist")})
    return store.with_cells(keyed)


def import_files(
    store: GasStore,
    manifest: Manifest,
    files: DataFrame,
    config: QcConfig = QcConfig(),
    series_pattern: str | None = None,
) -> tuple[int, int, set[Cell]]:
    """Import listed files as one batch, then record those that could be read.

    Returns how many files were recorded, their row count before cleaning, and the cells that changed.
    """
    with staged(read_log_lines(store.spark, files, store.limits)) as lines:
        with staged(file_readings(store, lines, series_pattern)) as incoming:
            sources = lines.where("is_header").select("source_file")
            cells = merge_batch(store, incoming, sources, config, replaced_cells(store, manifest, files))
            manifest.mark_processed(readable_files(files, lines), file_spans(incoming))
        counts = lines.agg(
            F.count_if("is_header").alias("files"), F.count_if(~F.col("is_header")).alias("rows")
        ).first()
    return counts.files, counts.rows, cells


def finish_import(store: GasStore) -> None:
    """Merge small files, and make the hourly means where there are none yet."""
    if store.raw_exists():
        store.compact()
        if not store.hourly_exists():
            store.rebuild_hourly()


def _batches(files: DataFrame, size: int, total: int) -> Iterator[DataFrame]:
    """A listing of ``total`` files in batches of ``size`` by name.

    Files are dealt to range partitions and numbered inside each; the sizes of the partitions, which alone come to the
    driver, give every partition its first number.
    """
    if total <= size:
        if total:
            yield files
        return
    dealt = files.repartitionByRange("path").sortWithinPartitions("path")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = stage_table(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}))
    before, starts = 0, []
    for part, count in sorted(dealt.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += count
    starts = files.sparkSession.createDataFrame(starts, "_part int, _start long")
    numbered = dealt.join(F.broadcast(starts), "_part")
    for batch in range(-(-total // size)):
        here = F.floor((F.col("_start") + F.col("_place")) / size) == batch
        yield numbered.where(here).select("path", "modificationTime", "length")


def stream_folders(
    spark: SparkSession,
    folders: Iterable[str],
    manifest: DataFrame | None = None,
    batch_size: int = 50,
    force_reimport: bool = False,
) -> Iterator[tuple[DataFrame, DataFrame, int]]:
    """Yield new files batch by batch as (log lines, files that could be read, number of files skipped)."""
    found = discover_files(spark, folders)
    fresh = found if manifest is None or force_reimport else new_files(found, manifest)
    total = fresh.count()
    skipped = found.count() - total
    for files in _batches(fresh, batch_size, total):
        lines = read_log_lines(spark, files)
        yield lines, readable_files(files, lines), skipped


def import_folders(
    store: GasStore,
    manifest: Manifest,
    folders: Sequence[str],
    config: QcConfig = QcConfig(),
    batch_size: int = 200,
    force_reimport: bool = False,
    series_pattern: str | None = None,
) -> ImportSummary:
    """Import what is new under the folders; the manifest is extended after every batch.

    ``series_pattern`` names instruments: its first group, found in a file's path, tells whose readings it holds.
    """
    with scratch(store.spark):
        found = stage_table(discover_files(store.spark, folders))
        fresh = found if force_reimport else stage_table(new_files(found, manifest.read()))
        return _import_found(store, manifest, found, fresh, config, batch_size, series_pattern)


def _import_found(
    store: GasStore,
    manifest: Manifest,
    found: DataFrame,
    fresh: DataFrame,
    config: QcConfig,
    batch_size: int,
    series_pattern: str | None,
) -> ImportSummary:
    total = fresh.count()
    skipped = found.count() - total
    files = rows = 0
    for batch in _batches(fresh, batch_size, total):
        done = import_files(store, manifest, batch, config, series_pattern)
        files, rows = files + done[0], rows + done[1]
    finish_import(store)
    return ImportSummary(files, skipped, rows, manifest.last_sync())


# As a stream


@dataclass
class _Listing(InputPartition):
    number: int


class _ListingReader(DataSourceStreamReader):
    """One row for each listing that is due; its offset is the number of the latest."""

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Listing(end["listing"])]

    def read(self, partition: _Listing) -> Iterator[tuple]:
        yield (partition.number,)


class ListingSource(DataSource):
    """A stream of listings: every trigger asks for one."""

    @classmethod
    def name(cls) -> str:
        return "aeroseries_listings"

    def schema(self) -> str:
        return "listing long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ListingReader()


def import_stream(
    store: GasStore,
    manifest: Manifest,
    folder: str,
    checkpoint: str,
    config: QcConfig = QcConfig(),
    files_per_trigger: int = 200,
    series_pattern: str | None = None,
) -> None:
    """The same as a stream that stops when it has caught up.

    Each trigger lists the folder on the executors, whatever the names, and stores the listing beside the stream's checkpoint under
    its offset. A micro-batch that runs again after a failure finds its listing there and imports of it what the
    manifest does not hold yet.
    """
    spark = store.spark
    spark.dataSource.register(ListingSource)
    listings = spark.readStream.format(ListingSource.name()).load()

    def import_batch(batch: DataFrame, number: int) -> None:
        path = f"{checkpoint}/listings/{number}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            with scratch(spark):
                discover_files(spark, [folder]).select(*IDENTITY).write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
        with scratch(spark):
            fresh = stage_table(new_files(found, manifest.read()))
            _import_found(store, manifest, found, fresh, config, files_per_trigger, series_pattern)

    query = (
        listings.writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
