"""Paths on whatever file system the cluster uses."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    system, location = _located(spark, path)
    return system.exists(location)


def list_files(spark: SparkSession, folder: str) -> Iterator[tuple[str, int, int]]:
    """Path, time in milliseconds and size of all files at any depth, with those whose names start with _ or a dot."""
    system, location = _located(spark, folder)
    found = system.listFiles(location, True)
    while found.hasNext():
        status = found.next()
        yield status.getPath().toString(), status.getModificationTime(), status.getLen()


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob pattern matches anything."""
    system, location = _located(spark, pattern)
    return len(system.globStatus(location) or ()) > 0


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a glob pattern."""
    system, location = _located(spark, pattern)
    return [status.getPath().toString() for status in system.globStatus(location) or ()]


def absolute_uri(spark: SparkSession, path: str) -> str:
    """The path as Spark reports it for files, with scheme and without relative parts."""
    system, location = _located(spark, path)
    return system.makeQualified(location).toString()


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver's JVM ends."""
    system, location = _located(spark, path)
    system.deleteOnExit(location)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None when it is missing."""
    system, location = _located(spark, path)
    if not system.exists(location):
        return None
    stream = system.open(location)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, location = _located(spark, path)
    stream = system.create(location, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none when it is missing."""
    system, location = _located(spark, folder)
    if not system.exists(location):
        return []
    return [status.getPath().getName() for status in system.listStatus(location)]


# On executors, where there is no Hadoop file system: through Arrow.


def opened(path: str):
    """The file system and the place in it of a path as Spark reports it."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(quote(f"{'s3' if scheme == 's3a' else scheme}:{rest}", safe=":/@?=&"))


def readable_on_executors(path: str) -> bool:
    """Whether Arrow knows the scheme of a path."""
    try:
        opened(path)
    except (ValueError, OSError):
        return False
    return True


def list_folder(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """Path, whether it is a folder, time in milliseconds and size of what lies in a folder, hidden names too.

    A path of a file gives that file, a missing one nothing.
    """
    from pyarrow import fs

    system, place = opened(folder)
    found = system.get_file_info(place)
    if found.type == fs.FileType.File:
        yield folder, False, (found.mtime_ns or 0) // 1_000_000, found.size
    elif found.type == fs.FileType.Directory:
        for info in system.get_file_info(fs.FileSelector(place)):
            path = f"{folder.rstrip('/')}/{info.base_name}"
            yield path, info.type == fs.FileType.Directory, (info.mtime_ns or 0) // 1_000_000, max(info.size or 0, 0)


def _after_line_break(source, at: int, size: int) -> int:
    """The place after the first line end that starts at the byte before ``at`` or later."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    at -= 1
    while at < size:
        source.seek(at)
        block = source.read(1 << 16)
        ends = [i for i in (block.find(b"\n"), block.find(b"\r")) if i >= 0]
        if not ends:
            at += len(block)
            continue
        end = at + min(ends)
        source.seek(end)
        return end + 2 if source.read(2) == b"\r\n" else end + 1
    return size


def read_lines(path: str, start: int, end: int) -> str:
    """The lines of a file that start in a range of bytes; ranges side by side give every line once."""
    system, place = opened(path)
    with system.open_input_file(place) as source:
        size = source.size()
        first, last = _after_line_break(source, start, size), _after_line_break(source, end, size)
        source.seek(first)
        return source.read(max(0, last - first)).decode("utf-8", "replace")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it; nothing happens when it is missing."""
    system, location = _located(spark, path)
    system.delete(location, True)
