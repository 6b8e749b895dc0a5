"""Incremental ingest with Structured Streaming, idempotent by chunk id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.common import cut, remove_folder, shared_folder
from quillgraph.sources.stores import latest


def chunk_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder of chunks, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def ingest_into(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str):
    """Writes each micro-batch's rows, one per key, to its own folder below
    ``target``; a batch that runs again overwrites the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The store as it stands: of each key the last row over all batches."""
    return latest(spark.read.parquet(target).drop("batch"), keys, order)


def exposure_totals(events: DataFrame, delay: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Exposures per user and window with a watermark: reinforcement and last seen."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("reinforcement"), F.max("ts").alias("last_seen"))


def replay(spark: SparkSession, source: str, keys: list[str], order: str) -> DataFrame:
    """One run of the stream over a folder, and the resulting store; the stream's own
    folders are deleted once the store is stored as the result."""
    import uuid

    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = ingest_into(chunk_stream(spark, source, spark.read.parquet(source).schema), f"{base}/store", keys, order, f"{base}/state")
    query.awaitTermination()
    rows = cut(current_rows(spark, f"{base}/store", keys, order))
    remove_folder(spark, base)
    return rows
