"""Usage events as a stream of closed JSON files: idempotent ingest and session totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(folder)


def once(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of each external_id within the watermark."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["external_id"])


def hourly_tokens(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Token sums by hour and model, appended when the watermark has passed the hour."""
    return once(events, delay).groupBy(F.window("occurred_at", "1 hour").alias("hour"), "model").agg(F.sum("tokens").alias("tokens")).select(F.col("hour.start").alias("hour"), "model", "tokens")


def run_available(out: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what is there, writes Parquet, and ends."""
    out.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
