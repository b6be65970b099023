"""Streams of segments: first deliveries, arrivals per period, and incremental embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_deliveries(segments: DataFrame, delay: str = "7 days") -> DataFrame:
    """Segments once per id within the watermark; later redeliveries than that pass again."""
    timed = segments.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return timed.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["id"])


def arrivals(segments: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Segments per kind and tumbling window of arrival; a window is final once the watermark has passed it."""
    timed = segments.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", delay)
    return timed.groupBy(F.window("ingested_at", window), "kind").agg(F.count("*").alias("segments")).select("window.start", "kind", "segments")


def embed_incrementally(segments: DataFrame, embed: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, kind: str) -> StreamingQuery:
    """Embed what arrives without a vector, micro-batch by micro-batch, into Parquet. Each batch has its own folder, so a repeated one replaces itself."""
    def work(batch: DataFrame, number: int) -> None:
        embed(batch.filter((F.col("kind") == kind) & F.col("embedding").isNull()).dropDuplicates(["id"])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return segments.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
