"""Cutting a long lineage: what several steps use is written once, to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


_dropped: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("dropped", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; in local mode, where none is set, one of our own until the end."""
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="threadmill-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
        own = spark.sparkContext.getCheckpointDir()
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint. Its files go when the frame is collected as garbage, if the session says so."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame, written to a folder of its own and read from there, and the folder, for who can say when it may go."""
    return written_in_blocks([df])


def written_in_blocks(blocks: Iterable[DataFrame]) -> tuple[DataFrame, str]:
    """As ``written``, of frames of the same columns, one after the other: what was moved for one is deleted before the next begins."""
    path = schema = spark = None
    for df in blocks:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
            if (dropped := _dropped.get()) is not None:
                dropped.append(path)
        df.write.mode("append").option("compression", "zstd").parquet(path)
        del df
        forget(spark)
    return spark.read.schema(schema).parquet(path), path


@contextlib.contextmanager
def dropping(spark: SparkSession) -> Iterator[list[str]]:
    """Stages that are written meanwhile are deleted in the end, but for the folders that are put into the list."""
    kept: list[str] = []
    before = _dropped.set([])
    try:
        yield kept
    finally:
        paths = _dropped.get()
        _dropped.reset(before)
        for path in paths:
            if path not in kept:
                remove(spark, path)


def forget(spark: SparkSession) -> None:
    """Have the shuffle files of jobs that are over deleted now: else they stay until the driver happens to collect its garbage.

    Spark's event queues hold their last event, and with it the plan of the last job, until another one comes: so a job of one row is run first.
    """
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    time.sleep(0.1)
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
