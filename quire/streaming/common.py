"""Shared helpers for the streaming jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep large key state off the JVM heap unless a provider is configured."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB)


def run_available(writer, checkpoint: str, available_now: bool = True,
                  processing_time: str | None = None):
    """Start a query that processes what is there (availableNow) or runs on a
    timer; with availableNow the call returns when the backlog is done."""
    writer = writer.option("checkpointLocation", checkpoint)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    q = writer.start()
    if available_now and not processing_time:
        q.awaitTermination()
    return q
