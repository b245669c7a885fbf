"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, in a temporary folder under a local master (as in tests);
    elsewhere that would be another folder on each machine, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.biblioscope.localDir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="biblioscope-")
        spark.conf.set("spark.biblioscope.localDir", base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by Spark's own readers (so on any store, and by Spark Connect)."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which outlives any executor."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_at(df, label))


def stored_at(df: DataFrame, label: str, *by: str) -> str:
    """The path of df as a Parquet table in the shared folder, with a folder for each value of the columns `by`."""
    path = shared_path(df.sparkSession, label)
    _made.append(path)
    df.write.partitionBy(*by).parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder; nothing where it is gone, or where the session has no file system of its own (Connect)."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside go at the end, all but the last: for steps whose stored result is all that is needed of them."""
    before = len(_made)
    yield
    for path in _made[before:-1]:
        delete(spark, path)
    del _made[before:-1]


def discard(spark: SparkSession) -> int:
    """Removes all tables that stored() has written in this process and that are left; returns their number. For when their results are no longer read."""
    for path in _made:
        delete(spark, path)
    n = len(_made)
    _made.clear()
    return n
