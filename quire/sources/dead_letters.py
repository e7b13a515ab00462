"""Failed responses (J35), kept with their reason until a later run reads them.

A letter is a response, known by its source, task, fetch time and file, not by
its text: a mended text is the same letter. The table only grows: each run
writes one partition, named by the run, with the letters that failed in it and
the earlier ones that it read well. A letter is pending if its latest row says
that it failed. Repeating a run replaces its own partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quire.schemas import PAYLOADS
from quire.sources import normalisers as N
from quire.sources.tables import read_table

FAILED, RESOLVED = "failed", "resolved"
LETTERS = T.StructType([*PAYLOADS.fields, T.StructField("letter_id", T.StringType()), T.StructField("state", T.StringType()),
                        T.StructField("reason", T.StringType()), T.StructField("attempt", T.IntegerType()),
                        T.StructField("run_id", T.StringType())])


def with_letter_id(payloads: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "keyword_idx", "fetched_at", "file_path")]
    return payloads.withColumn("letter_id", F.sha1(F.concat_ws("\n", *parts)))


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LETTERS)


def latest_letters(letters: DataFrame) -> DataFrame:
    """The last row of each letter: the highest attempt, of equal ones the last run."""
    rest = [c for c in LETTERS.fieldNames() if c != "letter_id"]
    last = F.max_by(F.struct(*rest), F.struct("attempt", "run_id")).alias("l")
    return letters.groupBy("letter_id").agg(last).select(*[F.col("letter_id") if c == "letter_id" else F.col(f"l.{c}")
                                                           for c in LETTERS.fieldNames()])


def pending_letters(spark: SparkSession, path: str, most_attempts: int | None = None) -> DataFrame:
    """The letters that still wait: mend their ``body`` (or fetch it again) and
    hand them to a harvest. Those that failed ``most_attempts`` times stay out."""
    waiting = latest_letters(read_letters(spark, path)).where(F.col("state") == FAILED)
    return waiting if most_attempts is None else waiting.where(F.col("attempt") < most_attempts)


def settle(payloads: DataFrame, path: str, run_id: str, sources: list[str] | None = None) -> None:
    """Write down how the responses of a run fared: those that failed, with
    their reason and how often they have, and the pending ones that did not."""
    spark = payloads.sparkSession
    judged = with_letter_id(N.judge_payloads(payloads, sources))
    earlier = latest_letters(read_letters(spark, path).where(F.col("run_id") != run_id)).select(
        "letter_id", F.col("attempt").alias("before"), (F.col("state") == FAILED).alias("waits"))
    rows = judged.join(earlier, "letter_id", "left").where(F.col("reason").isNotNull() | F.col("waits"))
    rows = rows.select(*PAYLOADS.fieldNames(), "letter_id", F.when(F.col("reason").isNull(), RESOLVED).otherwise(FAILED).alias("state"),
                       "reason", (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("attempt"), F.lit(run_id).alias("run_id"))
    # the table that is read is not the partition that is written
    rows = rows.checkpoint(eager=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
