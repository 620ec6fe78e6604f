"""Instrument log files: finding and reading them.

A log is whitespace-delimited text. Its header is the first line that names DATE and TIME; letter case
and column order are free, and other columns may be present.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroseries.config import REQUIRED_COLUMNS, ScaleLimits
from aeroseries.functions.files import (
    absolute_uri,
    list_files,
    list_folder,
    path_exists,
    read_lines,
    readable_on_executors,
)
from aeroseries.functions.lineage import stage_table
from aeroseries.schema import RAW_SCHEMA
from aeroseries.sources.catalog import new_files

# File name patterns, and what separates fields.
SYNC_PATTERN = r"DataLog_User_Sync\.dat$"
ANY_PATTERN = r"\.dat$"
DELIMITER = r"[\s,;]+"
#: What ends a line, in whole files and in ranges.
LINE_END = "\r\n|\n|\r"
#: Least bytes of a range; line numbers rest on it.
MIN_RANGE = 1 << 16


FOUND_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
    ]
)


_ENTRY_SCHEMA = "root string, path string, is_folder boolean, time long, length long"


def _entries(folders: DataFrame) -> DataFrame:
    """What lies in each folder of (root, path), listed by the executors."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, folder in zip(*(column.to_pylist() for column in batch.columns)):
                rows = [(root, *entry) for entry in list_folder(folder)]
                columns = list(zip(*rows)) or [()] * 5
                types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(columns, types)],
                    names=["root", "path", "is_folder", "time", "length"],
                )

    return folders.mapInArrow(look, _ENTRY_SCHEMA)


def list_tree(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """(root, path, time, length) of the files below each folder, level by level.

    The folders of one level are a table; each level lists them in parallel and stores what it found, so neither files nor
    folders are gathered on the driver. Where executors cannot reach a file system, the driver lists it.
    """
    roots = {folder: absolute_uri(spark, folder) for folder in folders}
    near = {folder: uri for folder, uri in roots.items() if readable_on_executors(uri)}
    listed = [
        (folder, path, time, length)
        for folder in roots.keys() - near.keys()
        if path_exists(spark, folder)
        for path, time, length in list_files(spark, folder)
    ]
    found = spark.createDataFrame(listed, "root string, path string, time long, length long")
    # A local relation has few partitions; each level is dealt out anew.
    width = max(spark.sparkContext.defaultParallelism, 8)
    level = spark.createDataFrame(list(near.items()), "root string, path string")
    while near and not level.isEmpty():
        entries = stage_table(_entries(level.repartition(width)))
        found = found.unionByName(entries.where("NOT is_folder").drop("is_folder"))
        level = entries.where("is_folder").select("root", "path")
    return found


def _listing(spark: SparkSession, folders: Iterable[str], pattern: str) -> DataFrame:
    """Path, time and size of matching files at any depth; file contents are not read.

    Files of zero bytes are left out: they are neither read nor rejected nor recorded. A file below two of the folders
    counts once.
    """
    named = list_tree(spark, folders).where((F.col("length") > 0) & F.substring_index("path", "/", -1).rlike(pattern))
    found = named.groupBy("path").agg(F.max("time").alias("time"), F.max("length").alias("length"))
    return found.select("path", F.timestamp_millis("time").alias("modificationTime"), "length")


def discover_month_files(
    spark: SparkSession, data_root: str, month_dirs: Iterable[str] | None = None
) -> DataFrame:
    """Sync logs under the given month folders, or under every folder with an all-digit name."""
    if month_dirs:
        return _listing(spark, [f"{data_root}/{month}" for month in month_dirs], SYNC_PATTERN)
    root = absolute_uri(spark, data_root).rstrip("/") + "/"
    below_root = F.substr(F.col("path"), F.lit(len(root) + 1))
    return _listing(spark, [data_root], SYNC_PATTERN).where(below_root.rlike(r"^[0-9]+/"))


def discover_files(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """All ``.dat`` files below the listed folders; missing folders are skipped."""
    return _listing(spark, list(folders), ANY_PATTERN)


def count_files(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """Number of ``.dat`` files below each listed folder."""
    folders = list(dict.fromkeys(folders))
    is_log = (F.col("length") > 0) & F.substring_index("path", "/", -1).rlike(ANY_PATTERN)
    counted = list_tree(spark, folders).groupBy("root").agg(F.count_if(is_log).alias("files"))
    asked = spark.createDataFrame([(folder,) for folder in folders], "folder string")
    counted = asked.join(counted, asked["folder"] == counted["root"], "left")
    return counted.select("folder", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


# Lines to rows


def _is_header(line: Column) -> Column:
    upper = F.upper(line)
    return upper.contains("DATE") & upper.contains("TIME")


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _tokens(line: Column) -> Column:
    return F.split(_stripped(line), DELIMITER)


def _positions(header: Column) -> Column:
    """Where each required column stands in the header, 1-based; null when one is missing."""
    names = F.transform(_tokens(header), F.upper)
    at = [F.array_position(names, column.upper()).cast("int") for column in REQUIRED_COLUMNS]
    complete = at[0] > 0
    for position in at[1:]:
        complete = complete & (position > 0)
    return F.when(complete, F.array(*at))


def _read_or_reject(positions: Column, path: Column, strict: bool) -> Column:
    if not strict:
        return positions
    return F.coalesce(positions, F.raise_error(F.concat(F.lit("missing required columns in "), path)))


def _once(value: Column) -> Column:
    """A generator of the one value, so that filters on what is made of it do not work it out again."""
    return F.explode(F.array(value))


def whole_file_rows(files: DataFrame, strict: bool = False) -> DataFrame:
    """Header and data rows of files given as ``(path, value)`` with the whole text in one value.

    Header and lines come from the same row, so nothing is joined or shuffled.
    """
    lines = files.select("path", _once(F.split("value", LINE_END, -1)).alias("lines"))
    leading = F.transform("lines", _is_header)
    headed = lines.select("*", _once(F.array_position(leading, True).cast("int")).alias("header_at"))
    header = F.try_element_at("lines", F.nullif("header_at", F.lit(0)))
    headed = headed.select("*", _once(_read_or_reject(_positions(header), F.col("path"), strict)).alias("positions"))
    headed = headed.where(F.col("positions").isNotNull())
    lines = headed.select("path", "positions", "header_at", F.posexplode("lines").alias("pos", "line"))
    lines = lines.where(F.col("pos") >= F.col("header_at") - 1)
    return _rows(lines, F.col("pos").cast("long"), F.col("pos") == F.col("header_at") - 1)


def split_file_rows(lines: DataFrame, broadcast_headers: bool, strict: bool = False) -> DataFrame:
    """The same of files given as ``(path, block, id, line)``, where a large file arrives in several splits.

    ``id`` grows along a split and ``block`` is the split's offset, so both together give the line order. The
    header table has one small row per file.
    """
    place = F.when(_is_header(F.col("line")), F.struct("block", "id"))
    start = lines.groupBy("path").agg(
        F.min(place)["block"].alias("header_block"),
        F.min(place)["id"].alias("header_id"),
        F.min_by("line", place).alias("header"),
    )
    positions = _positions(F.col("header"))
    headers = start.select(
        "path", "header_block", "header_id", _read_or_reject(positions, F.col("path"), strict).alias("positions")
    ).where(F.col("positions").isNotNull())
    headers = F.broadcast(headers) if broadcast_headers else headers
    below = (F.col("block") > F.col("header_block")) | (
        (F.col("block") == F.col("header_block")) & (F.col("id") >= F.col("header_id"))
    )
    rows = lines.join(headers, "path").where(below)
    # splits start at least 64 KiB apart, and ids count rows in their low 33 bits
    line_no = F.shiftleft(F.shiftright("block", 16), 33) + F.col("id").bitwiseAND((1 << 33) - 1)
    return _rows(rows, line_no, (F.col("block") == F.col("header_block")) & (F.col("id") == F.col("header_id")))


def _rows(lines: DataFrame, line_no: Column, is_header: Column) -> DataFrame:
    split = lines.where(_stripped(F.col("line")) != "").withColumn("tokens", _tokens(F.col("line")))
    columns = [
        F.try_element_at("tokens", F.col("positions")[i]).alias(name) for i, name in enumerate(REQUIRED_COLUMNS)
    ]
    # a generator, so that later filters on these columns do not split the line again
    return split.select(
        F.inline(F.array(F.struct(*columns))),
        F.col("path").alias("source_file"),
        line_no.alias("line_no"),
        is_header.alias("is_header"),
    )


def _texts(parts: DataFrame) -> DataFrame:
    """(path, start, value): the lines of each range of bytes of a file, read by the executors.

    Paths come as rows, so that the files of a batch are chosen by joins; Spark's own readers take a list on the driver,
    and pass over names that start with _ or a dot.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(column.to_pylist() for column in batch.columns)):
                text = read_lines(path, start, end)
                columns = [pa.array([path]), pa.array([start], pa.int64()), pa.array([text])]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "value"])

    return parts.mapInArrow(read, "path string, start long, value string")


def _spark_texts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The same by Spark's reader, for file systems that only Spark reaches: whole files, no hidden names."""
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", path) for (path,) in files.select("path").toLocalIterator()]
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    texts = spark.read.text(paths, wholetext=True) if paths else spark.createDataFrame([], "value string, _metadata struct<file_path:string>")
    return texts.select(F.url_decode(encoded).alias("path"), F.lit(0).cast("long").alias("start"), "value")


def read_log_lines(
    spark: SparkSession, files: DataFrame, limits: ScaleLimits = ScaleLimits(), strict: bool = False
) -> DataFrame:
    """Rows of the listed files with ``is_header`` set on each readable file's header row.

    Files without a complete header give no rows, or an error when ``strict``. Ordinary files are read whole, in one
    pass. Large files are read in ranges, so that one of them cannot fill a task. ``files`` should be a stored table: it is
    looked at several times.
    """
    step = max(limits.whole_file_bytes, MIN_RANGE)
    large = F.col("length") > limits.whole_file_bytes
    sums = files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(large).alias("large"), F.first("path").alias("path")
    ).first()
    if sums.path is None:
        return spark.createDataFrame([], RAW_SCHEMA).withColumn("is_header", F.lit(False))
    if not readable_on_executors(sums.path):
        return whole_file_rows(_spark_texts(spark, files).drop("start"), strict)
    # As many tasks as there are blocks of the advised size, and no fewer than there are cores.
    tasks = max(spark.sparkContext.defaultParallelism, -(-sums.bytes // step))
    whole = files.where(~large).select("path", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    parts = [whole_file_rows(_texts(whole.repartition(tasks)).drop("start"), strict)]
    if sums.large:
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start")
        ranges = files.where(large).select("path", starts).withColumn("end", F.col("start") + step)
        chunks = _texts(ranges.repartition(tasks))
        lines = chunks.select("path", F.col("start").alias("block"), F.posexplode(F.split("value", LINE_END, -1)).alias("id", "line"))
        lines = lines.withColumn("id", F.col("id").cast("long"))
        parts.append(split_file_rows(lines, sums.large <= limits.broadcast_files, strict))
    return union_sources(parts)


def data_rows(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("is_header")).drop("is_header")


def read_logs(
    spark: SparkSession, files: DataFrame, limits: ScaleLimits = ScaleLimits(), strict: bool = False
) -> DataFrame:
    """Raw rows of the listed files: five text columns, ``source_file`` and ``line_no``."""
    return data_rows(read_log_lines(spark, files, limits, strict))


def readable_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Listed files whose header is complete."""
    headers = lines.where("is_header").select(F.col("source_file").alias("path"))
    return files.join(headers, "path", "left_semi")


def rejected_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Listed files without a complete header."""
    headers = lines.where("is_header").select(F.col("source_file").alias("path"))
    return files.join(headers, "path", "left_anti")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns, matched by name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def load_all(spark: SparkSession, data_root: str, month_dirs: Iterable[str] | None = None) -> DataFrame:
    """Raw rows of all month files; an error when there are none, or when one turns out to be unreadable."""
    files = discover_month_files(spark, data_root, month_dirs)
    if files.isEmpty():
        raise FileNotFoundError(f"no DataLog_User_Sync.dat files under {data_root}")
    return read_logs(spark, files, strict=True)


def load_folders(
    spark: SparkSession, folders: Iterable[str], manifest: DataFrame | None = None, force_reimport: bool = False
) -> DataFrame:
    """Raw rows of the folders' files that the manifest does not know yet."""
    files = discover_files(spark, folders)
    if manifest is not None and not force_reimport:
        files = new_files(files, manifest)
    return read_logs(spark, files)
