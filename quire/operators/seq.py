"""Contiguous surrogate numbering (J47) without a global single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def assign_seq(df: DataFrame, order: list[str | Column], base: int | Column = 0,
               seq_col: str = "seq", partitions: int | None = None) -> DataFrame:
    """``seq`` = base + 1, 2, ... in ``order``, contiguous.

    Rows are range-partitioned on the order keys (sampled bounds, so one hot
    group is spread over many tasks), sorted inside each partition, and given
    a position from ``monotonically_increasing_id``. A per-partition count
    (one row per partition, broadcast) turns positions into global numbers.
    Ties in ``order`` are numbered in an unspecified order; pass a unique
    last key for a reproducible numbering.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
    # at most one row per partition: a window over it is tiny
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_p0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    b = base if isinstance(base, Column) else F.lit(int(base))
    seq = (b + F.col("_off") + (F.col("_pos") - F.col("_p0")) + 1).cast("long")
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(seq_col, seq).drop("_pid", "_pos", "_p0", "_off"))
