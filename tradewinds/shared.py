"""Tables that a job writes where the driver and every executor can read them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, or else the session's checkpoint folder.

    Where neither is set, a session of one machine (master local) gets a folder of its own; a cluster, whose executors would not see it, is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_tradewinds_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark._tradewinds_dir = tempfile.mkdtemp(prefix="tradewinds-")
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once into the shared folder and read it back: the lineage ends there, and a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tw-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tradewinds_path = path
    return out


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A table of the shared folder without rows, for `append`."""
    return materialise(spark.createDataFrame([], schema))


def append(df: DataFrame, to: DataFrame) -> None:
    """Add rows to a table of `materialise`."""
    df.select(*to.columns).write.mode("append").parquet(to._tradewinds_path)


def reread(df: DataFrame) -> DataFrame:
    """A table of `materialise` with what was added to it."""
    return df.sparkSession.read.schema(df.schema).parquet(df._tradewinds_path)


def release(df: DataFrame) -> None:
    """Delete a table of `materialise` that no later plan reads."""
    path = getattr(df, "_tradewinds_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    """Tables that results read lazily stay until the driver ends."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
