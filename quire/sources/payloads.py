"""Landed source responses (J01): the input of a harvest run.

Two layouts are read:

* a response table (Parquet, PAYLOADS schema, partitioned by ``source``),
  as the fetch side lands it: ``land_payloads`` / ``read_payloads``;
* raw response files: ``<root>/source=<s>/keyword_idx=<i>/<name>``, read whole,
  as a table or as a stream; folders that a run does not ask for are not read;
  the fetch time is the file's modification time and the keyword text comes
  from the run's keyword list. A file holds one response, or several with
  ``SEPARATOR`` after each: these have their place in the file behind its path.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quire.schemas import PAYLOADS
from quire.sources.drops import file_system


def land_payloads(payloads: DataFrame, landing_dir: str, mode: str = "append") -> str:
    payloads.select(*PAYLOADS.fieldNames()).write.mode(mode).partitionBy("source").parquet(landing_dir)
    return landing_dir


def read_payloads(spark: SparkSession, landing_dir: str) -> DataFrame:
    """The response table; filters on ``source`` prune partitions."""
    return spark.read.schema(PAYLOADS).parquet(landing_dir).select(*PAYLOADS.fieldNames())


#: Between and after the responses of a raw file that holds several. No JSON and no XML text may hold this control character.
SEPARATOR = "\n\x1e\n"
RESPONSES_PER_FILE = 1000
#: A raw response file: its text, and the task that its folders name.
RAW_FILE = T.StructType([T.StructField("value", T.StringType()), T.StructField("source", T.StringType()),
                         T.StructField("keyword_idx", T.IntegerType())])


def read_raw_responses(spark: SparkSession, root: str, keywords: list[str], sources: list[str] | None = None,
                       keyword_idx: list[int] | None = None) -> DataFrame:
    """Raw response files -> PAYLOADS rows (status 200: only successful
    responses are landed). ``sources`` and ``keyword_idx`` choose
    folders: files of other sources are not listed, those of other keywords not
    opened."""
    reader = spark.read.schema(RAW_FILE).option("wholetext", True).option("basePath", root).format("text")
    files = reader.load(_source_folders(spark, root, sources) or root)
    return _responses(_chosen(files, sources, keyword_idx), keywords)


def stream_raw_responses(spark: SparkSession, root: str, keywords: list[str], sources: list[str] | None = None,
                         keyword_idx: list[int] | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream: each file is read once, in the micro-batch after it
    landed; Spark's file log, in the query's checkpoint, holds the offsets."""
    reader = spark.readStream.schema(RAW_FILE).option("wholetext", True).format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _responses(_chosen(reader.load(root), sources, keyword_idx), keywords)


def _source_folders(spark: SparkSession, root: str, sources: list[str] | None) -> list[str]:
    """The folders of the chosen sources; none without a choice, or if none has landed."""
    if sources is None:
        return []
    fs, p = file_system(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(f"{root.rstrip('/')}/{n}" for n in names if n.startswith("source=") and unquote(n.removeprefix("source=")) in sources)


def _chosen(files: DataFrame, sources: list[str] | None, keyword_idx: list[int] | None) -> DataFrame:
    if sources is not None:
        files = files.where(F.col("source").isin(*sources))
    return files if keyword_idx is None else files.where(F.col("keyword_idx").isin(*keyword_idx))


def _responses(files: DataFrame, keywords: list[str]) -> DataFrame:
    kw = F.try_element_at(F.array(*[F.lit(k) for k in keywords]).cast("array<string>"), F.col("keyword_idx") + 1)
    several = F.contains("value", F.lit(SEPARATOR))
    parts = F.split("value", SEPARATOR)
    last = F.when(several & F.endswith("value", F.lit(SEPARATOR)), F.size(parts) - 1).otherwise(F.size(parts))
    responses = files.select("source", "keyword_idx", "_metadata", several.alias("several"), F.posexplode(F.slice(parts, F.lit(1), last)))
    path = F.col("_metadata.file_path")
    return responses.select(
        "source", kw.alias("keyword"), "keyword_idx",
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("fetched_at"),
        F.lit(200).alias("status_code"), F.col("col").alias("body"),
        F.when(F.col("several"), F.concat(path, F.lit("#"), F.col("pos"))).otherwise(path).alias("file_path"))


def land_raw_responses(payloads: DataFrame, root: str) -> str:
    """Successful responses as raw files in the folder of their task, those of a
    task together, at most ``RESPONSES_PER_FILE`` in one. Errors land nothing."""
    rows = payloads.where(F.coalesce("status_code", F.lit(200)) < 400)
    # the responses of a task meet in one place, or in several if they are many
    rows.select("source", "keyword_idx", F.coalesce("body", F.lit("")).alias("value")).hint("rebalance", "source", "keyword_idx") \
        .write.mode("append").option("maxRecordsPerFile", RESPONSES_PER_FILE).option("lineSep", SEPARATOR) \
        .partitionBy("source", "keyword_idx").text(root)
    return root
