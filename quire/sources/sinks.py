"""Sinks: CSV drops, the paper table and the load log (the ledger has its own module).

Data writes name their own partition (``batch_id`` of a harvest, ``file_id``
of a loaded file) and overwrite only that, so repeating a run after a crash
replaces its own output instead of duplicating it. The load log only grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from quire.schemas import PAPER_COLUMNS


def _overwrite_partitions(df: DataFrame):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


# Records of one drop file.
DROP_RECORDS = 100_000


def write_drop(papers: DataFrame, drop_dir: str, batch_id: str,
               max_records_per_file: int = DROP_RECORDS) -> str:
    """One run's new papers as CSV with a header, fixed column order, extra
    columns ignored, NULL written as an empty field. Every value is quoted, so
    surrounding blanks survive the loader's trimming of unquoted fields.
    Returns the batch folder."""
    path = f"{drop_dir.rstrip('/')}/batch={batch_id}"
    w = (papers.select(*PAPER_COLUMNS).write.mode("overwrite")
         .option("header", True).option("quote", '"').option("escape", '"')
         .option("quoteAll", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.csv(path)
    return path


def append_papers(typed: DataFrame, table_path: str, max_records_per_file: int = 0) -> int:
    """Store loaded rows under the partition of their ``file_id``. Loading the
    same file again, in whatever company, replaces its rows. Returns the number
    of rows written, observed during the write itself (no second job);
    ``max_records_per_file`` plays the bulk-copy batch size."""
    obs = Observation("append_papers")
    w = _overwrite_partitions(typed.observe(obs, F.count(F.lit(1)).alias("rows")))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.partitionBy("file_id").parquet(table_path)
    return int(obs.get.get("rows", 0))


def append_load_log(log_rows: DataFrame, log_path: str) -> None:
    """Append the per-file log rows of one load (separate write after the
    data); rows of earlier loads are never replaced."""
    log_rows.write.mode("append").parquet(log_path)
