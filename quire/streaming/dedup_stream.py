"""Streaming key dedup (J82): first-seen rows per key across micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quire.operators.dedup import dedup_first
from quire.sources.tables import exists
from quire.streaming.common import run_available, use_rocksdb_state


def dedup_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """``dropDuplicates`` on the keys in append mode. The key state grows
    without bound, as the ledger does; it lives in RocksDB, not on the heap.
    Which of several rows arriving in the same micro-batch is kept is not
    specified: compare keys, or use ``first_arrivals``."""
    use_rocksdb_state(stream.sparkSession)
    return stream.dropDuplicates(keys)


def first_updates(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key of a micro-batch the row, all columns, that comes before all
    rows that the key has shown, in the order (whole numbers and times); the last
    one of a key is its winner. The state holds a key's first row, in RocksDB."""
    use_rocksdb_state(stream.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def rank(c: str) -> Column:
        value = F.unix_micros(F.col(c).cast("timestamp_ltz")) if kinds[c].startswith("timestamp") else F.col(c).cast("bigint")
        # a row without a value comes after all others
        return F.coalesce(value, F.lit((1 << 63) - 1)).alias(c)
    first = F.min_by(F.struct(*stream.columns), F.struct(*map(rank, order))).alias("first_row")
    return stream.groupBy(*keys).agg(first).select("first_row.*")


def first_arrivals(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, **trigger):
    """Run ``first_updates`` into the folder ``path``: a micro-batch writes a
    folder of its own, so a repeated one replaces itself."""
    def each_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    writer = first_updates(stream, keys, order).writeStream.outputMode("update").foreachBatch(each_batch)
    return run_available(writer, checkpoint, **trigger)


def read_first_arrivals(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str]) -> DataFrame:
    """The winning row of each key: the rows of the batch ``dedup_first``,
    however the stream was cut into micro-batches."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return dedup_first(spark.read.schema(schema).parquet(path).select(*schema.fieldNames()), keys, order)
