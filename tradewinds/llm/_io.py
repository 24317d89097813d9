"""Reading inputs, batches of bounded size, and ids of bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewinds.shared import append, empty_table, materialise, release, reread, shared_dir

__all__ = ["append", "configure", "crc_mod", "empty_table", "materialise", "release", "reread", "sample_ids", "shared_dir", "table"]

#: Rows and bytes of one Arrow batch at most: the same for every operator, so that the order in which queries are built and run does not matter.
ARROW_ROWS, ARROW_BYTES = 4000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configure(spark: SparkSession) -> None:
    """Bound the rows and bytes that a Python worker holds at once; a batch has at least one row, however long its text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def sample_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` distinct ids, the smallest by hash: the same sample at each run. Small enough to broadcast by that bound."""
    name = ids.columns[0]
    return ids.where(F.col(name).isNotNull()).distinct().orderBy(F.xxhash64(name), name).limit(most)
