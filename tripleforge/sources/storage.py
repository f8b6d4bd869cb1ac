"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder in local mode, on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tripleforge-")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: The shuffle files of a write go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def stored(df: DataFrame) -> DataFrame:
    """df written and read back: its lineage ends here, its shuffles' files are deleted, and lost executors cost nothing."""
    spark = df.sparkSession
    at, before = f"{shared_dir(spark)}/tripleforge-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def stored_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, stored; the tables that were stored to make it are deleted."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        out = make()
    finally:
        _made.reset(token)
    out = stored(out)
    for d in made:
        discard(d)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more (on a classic session: it asks the JVM's file system)."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
