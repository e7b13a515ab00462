"""Size-based layout of the paper table.

A load stores each file's papers as a partition of their own, so that loading
the file again replaces them. Compaction rewrites those small partitions as
segments: files of about ``SEGMENT_ROWS`` rows, each a range of ``seq``, that
keep every row's file identity. Smaller segments are only made of small tables. A list of the live segments with their ranges is
written as a new version after them, so readers see the old segments or the new
ones, never both.

A partition hides the rows of the same identity in segments. So a file that is
loaded again after compaction replaces its rows as before, and partitions that a
crash kept from being removed change nothing. Compaction and loads of one table
take turns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quire.operators.query import paper_by_seq
from quire.schemas import PAPER_STORED
from quire.sources.drops import file_system
from quire.sources.tables import exists, read_table

#: Rows of one segment, and ranges that a table is cut into at most while they stay below their usual size.
SEGMENT_ROWS, MOST_RANGES = 1_000_000, 256
STORED = T.StructType([*PAPER_STORED.fields, T.StructField("file_id", T.StringType())])
LIVE = T.StructType([T.StructField("segment", T.StringType()), T.StructField("lo", T.LongType()),
                     T.StructField("hi", T.LongType()), T.StructField("n", T.LongType())])


def range_count(rows: int, asked: int, usual: int) -> int:
    """Into how many ranges a table is cut: of ``asked`` rows each, or, where
    that makes more than ``MOST_RANGES``, of more rows up to the ``usual`` size.
    Each range is a folder and a row of a list, whose cost would outgrow the rows'."""
    size = max(asked, min(-(-rows // MOST_RANGES), usual))
    return max(1, -(-rows // size))


def _segments(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_segments"


def _lists(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_segment_lists"


def _names(spark: SparkSession, folder: str, key: str) -> list[str]:
    """The values of the partition folders ``key=...`` of a table."""
    if not exists(spark, folder):
        return []
    fs, p = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n.removeprefix(f"{key}=") for n in names if n.startswith(f"{key}="))


def live_segments(spark: SparkSession, table_path: str) -> list:
    """(segment, lo, hi, n) of the last complete list: one row a segment."""
    done = [v for v in _names(spark, _lists(table_path), "version")
            if exists(spark, f"{_lists(table_path)}/version={v}/_SUCCESS")]
    return read_table(spark, f"{_lists(table_path)}/version={max(done)}", LIVE).collect() if done else []


def _read_segments(spark: SparkSession, table_path: str, segments: list[str]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], STORED)
    paths = [f"{_segments(table_path)}/segment={s}" for s in segments]
    return spark.read.schema(STORED).parquet(*paths).select(*STORED.fieldNames())


def read_stored(spark: SparkSession, table_path: str, seq: int | None = None) -> DataFrame:
    """All papers with the identity of their file. With ``seq`` only the
    segments whose range holds it are read, and the partitions."""
    parts = read_table(spark, table_path, STORED)
    live = live_segments(spark, table_path)
    if not live:
        return parts
    rows = _read_segments(spark, table_path, [r["segment"] for r in live if seq is None or r["lo"] <= seq <= r["hi"]])
    return parts.unionByName(_not_in_parts(spark, table_path, rows))


def _not_in_parts(spark: SparkSession, table_path: str, rows: DataFrame) -> DataFrame:
    newer = _names(spark, table_path, "file_id")  # one name for each file since the last compaction
    if not newer:
        return rows
    ids = spark.createDataFrame([(i,) for i in newer], "file_id string")
    return rows.join(F.broadcast(ids), "file_id", "left_anti").select(*STORED.fieldNames())


def stored_paper_by_seq(spark: SparkSession, table_path: str, seq: int) -> DataFrame:
    """Point lookup that opens one segment, beside what was loaded since."""
    return paper_by_seq(read_stored(spark, table_path, seq), seq)


def compact_papers(spark: SparkSession, table_path: str, segment_rows: int = SEGMENT_ROWS, clean: bool = True) -> int:
    """Rewrite the partitions of loaded files, and the segments in which they
    have hidden rows, as segments. Returns the number of files taken in.

    Steps, each safe to stop after: the new segments are written (nobody reads
    them); the list that names them is written (they count now, and partitions
    still there hide their rows); the old partitions go; old segments go. With
    ``clean`` off the last two are left to the next call, as after a crash.
    """
    files = _names(spark, table_path, "file_id")
    if not files:
        return 0
    live = live_segments(spark, table_path)
    ids = F.broadcast(spark.createDataFrame([(i,) for i in files], "file_id string"))
    old = [r["segment"] for r in live]
    touched = set()
    if old:
        named = spark.read.schema(T.StructType([*STORED.fields, T.StructField("segment", T.StringType())])).parquet(
            _segments(table_path)).where(F.col("segment").isin(*old))
        touched = {r["segment"] for r in named.join(ids, "file_id", "left_semi").select("segment").distinct().collect()}
    rows = read_table(spark, table_path, STORED).unionByName(
        _not_in_parts(spark, table_path, _read_segments(spark, table_path, sorted(touched))))
    n = rows.count()
    last = max(_names(spark, _lists(table_path), "version"), default="00000000")
    version = f"{int(last[:8]) + 1:08d}-{uuid.uuid4().hex[:8]}"
    kept = [tuple(r) for r in live if r["segment"] not in touched]
    if n:
        (rows.repartitionByRange(range_count(n, segment_rows, SEGMENT_ROWS), "seq").sortWithinPartitions("seq")
         .withColumn("segment", F.concat(F.lit(f"{version}-"), F.lpad(F.spark_partition_id().cast("string"), 6, "0")))
         .write.mode("append").partitionBy("segment").parquet(_segments(table_path)))
        made = spark.read.schema(T.StructType([*STORED.fields, T.StructField("segment", T.StringType())])).parquet(
            _segments(table_path)).where(F.col("segment").startswith(f"{version}-"))
        kept += [tuple(r) for r in made.groupBy("segment").agg(
            F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n")).collect()]
    if sum(r[3] for r in kept) != n + sum(r["n"] for r in live if r["segment"] not in touched):
        raise RuntimeError("the new segments do not hold the rows of the old files")
    spark.createDataFrame(kept, LIVE).coalesce(1).write.parquet(f"{_lists(table_path)}/version={version}")
    if clean:
        drop_partitions(spark, table_path, files)
        drop_segments(spark, table_path, [r[0] for r in kept])
    return len(files)


def drop_partitions(spark: SparkSession, table_path: str, files: list[str]) -> None:
    for f in files:
        fs, p = file_system(spark, f"{table_path.rstrip('/')}/file_id={f}")
        fs.delete(p, True)


def drop_segments(spark: SparkSession, table_path: str, live: list[str]) -> None:
    """Remove the segments that no list needs, also those of broken runs, and old lists."""
    for s in set(_names(spark, _segments(table_path), "segment")) - set(live):
        fs, p = file_system(spark, f"{_segments(table_path)}/segment={s}")
        fs.delete(p, True)
    for v in _names(spark, _lists(table_path), "version")[:-1]:
        fs, p = file_system(spark, f"{_lists(table_path)}/version={v}")
        fs.delete(p, True)
