"""The stored paper table, load log and number reservations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.schemas import LOAD_LOG, LOAD_LOG_STORED, PAPER_STORED, SEQ_MARKS
from quire.sources.drops import file_system


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows under a declared schema: columns that older files lack read as
    NULL, and no footer is read to find the schema. Only a path that does not
    exist reads as empty; any other error is raised."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """The papers of loaded files and of segments (``sources.segments``)."""
    from quire.sources.segments import read_stored
    return read_stored(spark, path).select(*PAPER_STORED.fieldNames())


def read_load_log(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LOAD_LOG_STORED).select(*LOAD_LOG.fieldNames())


def seq_marks_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_seq"


def reserve_seq(spark: SparkSession, table_path: str, n: int) -> int:
    """Reserve ``n`` numbers and return the last one taken before them.

    The high-water mark is a small table of its own, one row per load, written
    before the papers: no load reads the stored ``seq`` column, and a load
    whose log row was lost never has its numbers given out again. A table
    without marks (from before they existed) is read once."""
    path = seq_marks_path(table_path)
    if exists(spark, path):
        base = read_table(spark, path, SEQ_MARKS).agg(F.max("upto")).first()[0]
    else:
        base = read_papers(spark, table_path).agg(F.max("seq")).first()[0]
    base = int(base or 0)
    spark.createDataFrame([(base + n,)], SEQ_MARKS).coalesce(1).write.mode("append").parquet(path)
    return base


def max_log_id(spark: SparkSession, log_path: str) -> int:
    v = read_load_log(spark, log_path).agg(F.max("log_id")).first()[0]
    return int(v or 0)


def ensure_tables(spark: SparkSession, table_path: str, log_path: str) -> None:
    """Create the folders of the paper table and the load log when missing
    (idempotent; existing tables are left as they are)."""
    for path in (table_path, log_path):
        fs, p = file_system(spark, path)
        if not fs.exists(p) and not fs.mkdirs(p):
            raise OSError(f"cannot create {path}")
