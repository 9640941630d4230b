"""Watch loops and saved-query monitors on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_hits(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(baseline.select(*keys), keys, "left_anti")


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and mean latency per type and window, with late rows bounded by the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def watch(source: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "10 seconds"):
    """Starts a stream that hands each batch of changed rows to ``on_change``; progress survives restarts."""
    return source.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


class Monitor:
    """A saved query: primes itself with the first hits, then appends an event per new hit to a table."""

    def __init__(self, spark: SparkSession, query: Callable[[DataFrame], DataFrame], path: str, keys: list[str]):
        self.spark, self.query, self.path, self.keys = spark, query, path, keys

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        hits = self.query(batch).select(*self.keys).distinct()
        try:
            known = self.spark.read.parquet(self.path).where(F.col("batch_id") != batch_id)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = None
        fresh = hits if known is None else new_hits(hits, known, self.keys)
        # one folder per batch: a batch that is run again replaces its own events
        out = fresh.withColumn("primed", F.lit(known is None)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path)
