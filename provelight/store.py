"""Intermediate tables that survive the loss of an executor.

A plan whose intermediate result is read more than once is cut by writing that
result as Parquet into the folder all executors share.  The folder is the one
the session names in ``spark.checkpoint.dir``; only a session without that
setting whose master is local (unit tests, a laptop) gets a temporary folder of
its own; on a cluster a session without it is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if named:
        return named.rstrip("/")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share; a machine's own folder would lose rows")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="provelight-"))
    return "file://" + _own[0]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> int:
    """Delete every intermediate table this process wrote; returns how many."""
    done = 0
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            done += 1
        except Exception:  # the session is gone; local files can still be removed
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
                done += 1
    return done


def _at_exit() -> None:
    sweep()  # by the file system of the folder while the session lives, else what is local
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_at_exit)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores.

    For work that is bound by the processor over a table that is one small file.
    A table with enough partitions, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
