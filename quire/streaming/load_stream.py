"""Incremental folder load (J80): new drop files -> load cycle per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.plans.load_run import run_load
from quire.streaming.common import run_available

# The binaryFile source's fixed schema (a stream needs it up front).
BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])
MAX_FILES = 2_000


def load_stream(spark: SparkSession, drop_dir: str, table_path: str, log_path: str,
                checkpoint: str, archive_dir: str | None = None,
                max_files_per_trigger: int = MAX_FILES, available_now: bool = True,
                processing_time: str | None = None, on_ragged: str = "load"):
    """Watch ``drop_dir`` for ``*.csv`` files and run a load cycle when new
    ones arrive, and once at the start.

    The stream says when to load; what to load is the folder's listing minus
    the log, as in the batch job. So FAILED and empty files are tried and
    logged in every cycle, a replayed micro-batch finds its files loaded, and
    a lost checkpoint or log row loads nothing twice (papers are stored by
    file identity). A cycle takes ``max_files_per_trigger`` files at a time.
    """
    def cycle() -> None:
        run_load(spark, drop_dir, table_path, log_path, archive_dir, on_ragged, max_files_per_trigger)

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        cycle()

    cycle()
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", max_files_per_trigger))
    return run_available(files.load(drop_dir).select("path").writeStream.foreachBatch(each_batch),
                         checkpoint, available_now, processing_time)
