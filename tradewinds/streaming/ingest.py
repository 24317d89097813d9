"""Beyond the batch engine: items that arrive as files, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradewinds.operators.panel import total


def arrivals(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New parquet files of a folder, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def late_panel(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("product", "partner"), window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums by window and key; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(total("value").alias("value"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "value", "n")


def gated_months(rows: DataFrame, root: str, checkpoint: str, gate: Callable[[DataFrame], bool]) -> StreamingQuery:
    """Each batch's flow and months are written as whole partitions if the quality gate lets it; a batch that it stops is set aside under `rejected`.

    A batch has a folder of its own, which a replay after a failure writes anew, so its rows are stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if gate(batch):
                batch.write.partitionBy("flow", "period").mode("overwrite").parquet(f"{root}/store/batch={number}", compression="zstd")
            else:
                batch.write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
