"""One load cycle over a drop folder.

create the tables -> list drops -> skip files already loaded -> one
header-aware scan, cleaned, typed, capped and staged -> reserve numbers ->
store papers by file identity -> append one log row per file -> archive.

A file's identity is its path, modification time and length. Its papers are
one partition of the table, so a repeated load replaces them; log rows are
only ever appended; archiving depends on the data alone, not on the log.
"""

from __future__ import annotations

import datetime as dt
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators.clean import cap_widths, conform, load_results, split_bad_rows, type_columns
from quire.schemas import FAILED, LOAD_LOG_STORED, PAPER_TYPED, PARTIAL, SUCCESS
from quire.session import drop_scratch, scratch_path
from quire.sources.drops import DropFile, file_system, list_drops, read_drops
from quire.sources.records import block_summaries, plain_name
from quire.sources.serving import write_serving
from quire.sources.sinks import append_load_log, append_papers
from quire.sources.tables import ensure_tables, max_log_id, read_load_log, read_table, reserve_seq

# Fixed value: error text logged for a drop without a header record.
NO_HEADER = "No header record was found."
# Files of one load: what the driver holds for a load (one result per file)
# stays bounded; more pending files are further loads of the same cycle.
FILES_PER_LOAD = 2_000


@dataclass
class LoadOutcome:
    files: int
    log: DataFrame          # the log rows written by this cycle
    loaded_rows: int


def clean_drops(spark: SparkSession, paths, headers: bool = False, on_ragged: str = "load") -> DataFrame:
    """Typed, capped paper rows with ``file_name`` and their place in it."""
    rows = read_drops(spark, paths, headers, on_ragged == "reject")
    return cap_widths(type_columns(conform(rows)))


def pending_files(spark: SparkSession, files: list[DropFile], log_path: str) -> list[DropFile]:
    """Drop files without a SUCCESS or PARTIAL row of their identity in the
    log. The listed files are broadcast into the log scan; only those of them
    that were loaded come back."""
    if not files:
        return []
    ids = spark.createDataFrame([(f.file_id,) for f in files], "file_id string")
    log = read_table(spark, log_path, LOAD_LOG_STORED).where(F.col("status").isin(SUCCESS, PARTIAL))
    done = {r.file_id for r in log.join(F.broadcast(ids), "file_id", "left_semi")
            .select("file_id").distinct().collect()}
    return [f for f in files if f.file_id not in done]


def _stage(spark: SparkSession, files: list[DropFile], on_ragged: str):
    """Scan, clean and write the files once: (scratch tables, failures). When
    a joint read fails the files are halved until the bad ones are alone, so
    one bad file costs a few more jobs and never stops the others."""
    path = scratch_path(spark, "load")
    try:
        clean_drops(spark, [f.path for f in files], True, on_ragged).write.parquet(path)
        return [path], []
    except Exception as e:  # noqa: BLE001 - any read failure: isolate the culprit
        drop_scratch(spark, path)
        _check_workers(spark)
        if len(files) == 1:
            return [], [(files[0], str(e) or type(e).__name__)]
        half = len(files) // 2
        a, b = _stage(spark, files[:half], on_ragged), _stage(spark, files[half:], on_ragged)
        return a[0] + b[0], a[1] + b[1]


def _check_workers(spark: SparkSession) -> None:
    """Raise when this package cannot run on the executors at all: then the
    cluster is at fault, and no file is to be logged as FAILED for it."""
    lines = spark.createDataFrame([("file:/x", 0, "a")], "file_name string, block bigint, value string")
    block_summaries(lines).collect()


def load_files(spark: SparkSession, files: list[DropFile], table_path: str, log_path: str,
               on_ragged: str = "load", serving: bool = False) -> list[DropFile]:
    """Load at most ``FILES_PER_LOAD`` files; returns those whose data is
    stored. Files that cannot be read, or have no header, are logged FAILED
    with zero counts and the whole error. Header-only files are not logged.
    With ``serving`` the tables beside the paper table get these files too."""
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    empty = [(f, NO_HEADER) for f in files if not f.length]
    staged, failed = _stage(spark, [f for f in files if f.length], on_ragged) if len(empty) < len(files) else ([], [])
    by_name = {f.path: f for f in files}
    stored, log_rows = [], []
    try:
        if staged:
            rows = spark.read.parquet(*staged)
            results = sorted(load_results(rows).collect(), key=lambda r: r.file_name)  # one per file of this load
            seen = {plain_name(r.file_name) for r in results}
            empty += [(f, NO_HEADER) for f in files if f.length and plain_name(f.path) not in seen
                      and all(f is not g for g, _ in failed)]
            names = {plain_name(p): f for p, f in by_name.items()}
            total = sum(r.loaded_rows for r in results)
            places, at = [], reserve_seq(spark, table_path, total) if total else 0
            for r in results:
                places.append((r.file_name, at, names[plain_name(r.file_name)].file_id))
                at += r.loaded_rows
            if total:
                offsets = spark.createDataFrame(places, "file_name string, _before bigint, file_id string")
                good, _ = split_bad_rows(rows.where("row_no > 0"), F.col("good_no").isNull())
                papers = good.join(F.broadcast(offsets), "file_name").select(
                    (F.col("_before") + F.col("good_no")).alias("seq"), *PAPER_TYPED.fieldNames(),
                    F.lit(started).cast("timestamp_ntz").alias("loaded_at"), "file_id")
                written = append_papers(papers, table_path)
                if written != total:  # both come from the same staged rows
                    raise RuntimeError(f"wrote {written} rows of {total}")
                if serving:
                    write_serving(spark, table_path, [file_id for _, _, file_id in places])
            for r in results:
                f = names[plain_name(r.file_name)]
                if r.total_rows:
                    stored.append(f)
                    log_rows.append((f, r.total_rows, r.loaded_rows, r.failed_rows, r.status, None,
                                     r.started_at, r.finished_at))
    finally:
        for path in staged:
            drop_scratch(spark, path)
    finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    log_rows += [(f, 0, 0, 0, FAILED, e, started, finished) for f, e in failed + empty]
    if log_rows:
        _write_log(spark, log_path, sorted(log_rows))
    return stored


def _write_log(spark: SparkSession, log_path: str, rows: list[tuple]) -> None:
    try:
        base = max_log_id(spark, log_path)
        data = [(base + i, f.path, *rest, f.file_id) for i, (f, *rest) in enumerate(rows, 1)]
        append_load_log(spark.createDataFrame(data, LOAD_LOG_STORED).coalesce(1), log_path)
    except Exception as e:  # noqa: BLE001 - a log failure never undoes the load
        warnings.warn(f"log write failed, the loaded data stays: {e}")


def run_load(spark: SparkSession, drop_dir: str, table_path: str, log_path: str,
             archive_dir: str | None = None, on_ragged: str = "load",
             files_per_load: int = FILES_PER_LOAD, serving: bool = False) -> LoadOutcome:
    """List the drop folder, load every file not loaded yet in path order and
    archive the loaded ones; FAILED files stay in place and are tried, and
    logged, again next time. ``on_ragged="reject"`` leaves out rows whose
    number of fields is not their header's and counts them as failed."""
    try:
        ensure_tables(spark, table_path, log_path)
    except Exception as e:  # noqa: BLE001 - without a log the data still loads
        warnings.warn(f"tables could not be created: {e}")
    first = _log_mark(spark, log_path)
    files = pending_files(spark, list_drops(spark, drop_dir, archive_dir), log_path) if first is not None \
        else list_drops(spark, drop_dir, archive_dir)
    for i in range(0, len(files), files_per_load):
        done = load_files(spark, files[i:i + files_per_load], table_path, log_path, on_ragged, serving)
        if archive_dir and done:
            archive_files(spark, [f.path for f in done], archive_dir, dt.datetime.now())
    if first is None:
        return LoadOutcome(len(files), spark.createDataFrame([], LOAD_LOG_STORED), 0)
    log = read_load_log(spark, log_path).where(F.col("log_id") > first)
    loaded = log.agg(F.coalesce(F.sum("loaded_rows"), F.lit(0))).first()[0]
    return LoadOutcome(len(files), log, int(loaded))


def _log_mark(spark: SparkSession, log_path: str) -> int | None:
    """The last log id, None when the log cannot be read at all."""
    try:
        return max_log_id(spark, log_path)
    except Exception as e:  # noqa: BLE001 - then every listed file is loaded; its partition is replaced
        warnings.warn(f"log cannot be read: {e}")
        return None


def archive_files(spark: SparkSession, paths: list[str], archive_dir: str,
                  when: dt.datetime) -> list[str]:
    """Move loaded files of one load under ``archive_dir/YYYY-MM-DD/``; on a
    name clash the file gets a ``_HHMMSS`` suffix, and a number if that is
    taken too. Renames are metadata calls, several at a time; one that fails
    is reported and the file, already loaded, stays."""
    day = f"{archive_dir.rstrip('/')}/{when:%Y-%m-%d}"
    fs, folder = file_system(spark, day)
    fs.mkdirs(folder)
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    taken: set[str] = set()
    moves = []
    for p in paths:
        name = new_path(p).getName()
        stem = name[:-4] if name.lower().endswith(".csv") else name
        dest, k = name, 0
        while dest in taken or fs.exists(new_path(folder, dest)):
            dest = f"{stem}_{when:%H%M%S}{f'_{k}' if k else ''}.csv"
            k += 1
        taken.add(dest)
        moves.append((p, dest))

    def move(pair):
        src, dest = new_path(pair[0]), new_path(folder, pair[1])
        try:
            ok = fs.rename(src, dest)
        except Exception as e:  # noqa: BLE001
            ok, pair = False, (f"{pair[0]} ({e})", "")
        if not ok:
            warnings.warn(f"could not archive {pair[0]}")
        return dest.toString() if ok else None
    with ThreadPoolExecutor(16) as pool:
        return [d for d in pool.map(move, moves) if d]
