"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from aeroseries.functions.files import delete, delete_on_exit

#: Staged tables of the innermost block that removes its own.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is set, a temporary one on a local master only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="aeroseries-checkpoint-")
        delete_on_exit(spark, folder)
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute a frame once and keep it in the checkpoint folder.

    Later steps read it from there: they neither repeat the work nor lose it with an executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _write_staged(df: DataFrame) -> str:
    path = f"{checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage_table(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage` for wide frames: a Parquet table, so that later scans read only what they need.

    What is planned on it may run at any time, so the table stays until the surrounding :func:`scratch` block or the
    driver ends.
    """
    path = _write_staged(df)
    kept = _scratch.get()
    if kept is None:
        delete_on_exit(df.sparkSession, path)
    else:
        kept.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged in this block are removed at its end; results must be written or collected by then."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            delete(spark, path)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """A staged table that is removed when the block ends."""
    path = _write_staged(df)
    try:
        yield df.sparkSession.read.parquet(path)
    finally:
        delete(df.sparkSession, path)
