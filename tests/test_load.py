"""CSV drops end to end: header variants, typing, numbering, log, re-run."""

import datetime as dt
import os
import shutil

from pyspark.sql import functions as F

from quire.plans.load_run import clean_drops, load_files, run_load
from quire.sources.drops import DropFile, list_drops
from quire.sources.tables import read_load_log, read_papers

HERE = os.path.join(os.path.dirname(__file__), "drops")
FILES = ["full_bom_crlf.csv", "old_header.csv", "reordered.csv", "header_only.csv"]  # upper_header.csv: own test


def _drops(scratch):
    d = os.path.join(scratch, "in")
    os.makedirs(d)
    for f in FILES:
        shutil.copy(os.path.join(HERE, f), d)
    return d


def test_header_variants(spark, scratch):
    got = {r.paper_number: r for r in clean_drops(spark, _drops(scratch)).collect()}
    assert set(got) == {"1", "2", "W1", "W2", "R1", "R2", "R3"}
    a = got["1"]
    assert (a.title, a.authors, a.doi, a.published_date, a.citation_count) == \
        ("Title, with comma", "A, B", "", dt.date(2025, 4, 7), 5)
    assert a.abstract.replace("\r\n", "\n") == 'line one\nline "two"'
    assert got["2"].title == "Padded" and got["2"].published_date == dt.date(2025, 4, 1)
    old = got["W1"]   # old header: optional columns NULL, required text present
    assert (old.keyword, old.doi, old.abstract, old.citation_count, old.journal) == (None,) * 5
    assert old.published_date == dt.date(2025, 1, 1)
    assert got["W2"].published_date is None and got["W2"].extracted_at is None  # 1899, blank
    r1 = got["R1"]    # reordered header maps by name
    assert (r1.url, r1.title, r1.keyword, r1.citation_count, r1.published_date) == \
        ("http://c/1", "Reordered", "kw c", 12, dt.date(2025, 4, 7))
    assert got["R2"].url == "" and got["R3"].journal == "J4"   # short and long rows load


def test_load_cycle_numbering_log_and_rerun(spark, scratch):
    drops = _drops(scratch)
    t, lg, ar = (os.path.join(scratch, x) for x in ("papers", "log", "archive"))
    out = run_load(spark, drops, t, lg)
    assert out.loaded_rows == 7
    log = {os.path.basename(r.file_name): r for r in out.log.collect()}
    assert set(log) == {"full_bom_crlf.csv", "old_header.csv", "reordered.csv"}  # header-only: no row
    assert all(r.status == "SUCCESS" and r.total_rows == r.loaded_rows for r in log.values())
    assert sorted(r.log_id for r in log.values()) == [1, 2, 3]
    papers = read_papers(spark, t).orderBy("seq").collect()
    assert [p.seq for p in papers] == list(range(1, 8))
    # file name order, then row order inside a file
    assert [p.paper_number for p in papers] == ["1", "2", "W1", "W2", "R1", "R2", "R3"]
    again = run_load(spark, drops, t, lg, archive_dir=ar)
    assert again.loaded_rows == 0 and read_papers(spark, t).count() == 7
    # a new file continues the numbering and the log ids
    new_dir = os.path.join(scratch, "in", "later")
    os.makedirs(new_dir)
    shutil.copy(os.path.join(HERE, "old_header.csv"), os.path.join(new_dir, "z_more.csv"))
    third = run_load(spark, drops, t, lg, archive_dir=ar)
    assert third.loaded_rows == 2
    assert read_papers(spark, t).agg(F.max("seq")).first()[0] == 9
    assert read_load_log(spark, lg).agg(F.max("log_id")).first()[0] == 4
    archived = [f for _, _, fs in os.walk(ar) for f in fs if f.endswith(".csv")]
    assert archived == ["z_more.csv"]


def test_failed_files_are_logged_and_kept(spark, scratch):
    drops = _drops(scratch)
    open(os.path.join(drops, "zero.csv"), "w").close()
    t, lg = os.path.join(scratch, "papers"), os.path.join(scratch, "log")
    out = run_load(spark, drops, t, lg, archive_dir=os.path.join(scratch, "archive"))
    log = {os.path.basename(r.file_name): r for r in out.log.collect()}
    z = log["zero.csv"]
    assert (z.status, z.total_rows, z.loaded_rows, z.failed_rows) == ("FAILED", 0, 0, 0)
    assert z.error_msg and os.path.exists(os.path.join(drops, "zero.csv"))  # stays for a retry
    assert out.loaded_rows == 7
    # a file that vanished between listing and reading fails alone
    good = DropFile("file:" + os.path.join(HERE, "old_header.csv"), 9, 1)
    gone = DropFile("file:" + os.path.join(drops, "vanished.csv"), 9, 1)
    done = load_files(spark, [good, gone], t + "2", lg + "2")
    st = {os.path.basename(r.file_name): r for r in read_load_log(spark, lg + "2").collect()}
    assert done == [good] and {k: r.status for k, r in st.items()} == {"old_header.csv": "SUCCESS", "vanished.csv": "FAILED"}
    assert "vanished.csv" in st["vanished.csv"].error_msg


def test_header_names_resolve_case_insensitively(spark):
    r = clean_drops(spark, os.path.join(HERE, "upper_header.csv")).first()
    assert (r.site_name, r.paper_number, r.doi, r.citation_count, r.journal) == \
        ("PLOS", "U1", "10.9/u", 3, "JU")


def test_retry_after_log_failure_does_not_duplicate(spark, scratch, monkeypatch):
    import quire.plans.load_run as LR
    drops = _drops(scratch)
    t, lg = os.path.join(scratch, "papers"), os.path.join(scratch, "log")

    def broken(*a, **k):
        raise OSError("log store unavailable")
    monkeypatch.setattr(LR, "append_load_log", broken)
    first = run_load(spark, drops, t, lg)
    assert first.log.count() == 0 and read_papers(spark, t).count() == 7   # data kept
    # the log write fails, a file arrives before the retry: nothing is stored twice
    monkeypatch.undo()
    shutil.copy(os.path.join(HERE, "upper_header.csv"), os.path.join(drops, "a_new.csv"))
    second = run_load(spark, drops, t, lg)
    assert second.loaded_rows == 8
    assert read_papers(spark, t).count() == 8      # same file -> same partition, replaced
    assert read_papers(spark, t).select("seq").distinct().count() == 8


def test_log_failure_does_not_keep_files_from_the_archive(spark, scratch, monkeypatch):
    import quire.plans.load_run as LR
    drops, t, lg, ar = (os.path.join(scratch, x) for x in ("in", "papers", "log", "archive"))
    _drops(scratch)
    monkeypatch.setattr(LR, "append_load_log", lambda *a, **k: 1 / 0)
    run_load(spark, drops, t, lg, archive_dir=ar)
    assert os.listdir(drops) == ["header_only.csv"]
    monkeypatch.undo()
    assert run_load(spark, drops, t, lg, archive_dir=ar).loaded_rows == 0
    assert read_papers(spark, t).count() == 7


def test_new_file_under_an_old_name(spark, scratch):
    drops, t, lg = (os.path.join(scratch, x) for x in ("in", "papers", "log"))
    ar = os.path.join(drops, "archive")             # the default place, inside the drop folder
    os.makedirs(drops)
    for name, rows in (("old_header.csv", 2), ("reordered.csv", 5), ("old_header.csv", 7)):
        shutil.copy(os.path.join(HERE, name), os.path.join(drops, "a.csv"))
        run_load(spark, drops, t, lg, archive_dir=ar)
        assert read_papers(spark, t).count() == rows
    assert run_load(spark, drops, t, lg, archive_dir=ar).loaded_rows == 0
    archived = sorted(f for _, _, fs in os.walk(ar) for f in fs if f.endswith(".csv"))
    assert len(archived) == 3 and archived[0] == "a.csv" and list_drops(spark, drops, ar) == []


def test_each_cycle_logs_its_failures(spark, scratch):
    drops, t, lg = (os.path.join(scratch, x) for x in ("in", "papers", "log"))
    os.makedirs(os.path.join(drops, "sub"))
    for p in ("z.csv", "sub/y.csv"):
        open(os.path.join(drops, p), "w").close()
    with open(os.path.join(drops, "blank.csv"), "w") as f:
        f.write("\n\n")
    for n in (3, 6):
        run_load(spark, drops, t, lg)
        rows = read_load_log(spark, lg).collect()
        assert len(rows) == n == len({r.log_id for r in rows}) and {r.status for r in rows} == {"FAILED"}


def test_wide_drops_and_ragged_rows(spark, scratch):
    drops, t, lg = (os.path.join(scratch, x) for x in ("in", "papers", "log"))
    os.makedirs(drops)
    with open(os.path.join(drops, "wide.csv"), "w") as f:
        f.write(",".join([f"x{i}" for i in range(60)] + ["title", "paper_number"]) + "\n")
        f.write(",".join([str(i) for i in range(60)] + ['"T, ""q"""', "P1"]) + "\n")
        f.write("short,row\n" + ",".join(["v"] * 61 + ["P2"]) + "\n")
    r = {x.paper_number: x for x in clean_drops(spark, drops).collect()}
    assert r["P1"].title == 'T, "q"' and r["P2"].title == "v" and r[""].title == ""
    out = run_load(spark, drops, t, lg, on_ragged="reject").log.first()
    assert (out.total_rows, out.loaded_rows, out.failed_rows, out.status) == (3, 2, 1, "PARTIAL")
    assert out.started_at <= out.finished_at
    assert sorted((p.seq, p.paper_number) for p in read_papers(spark, t).collect()) == [(1, "P1"), (2, "P2")]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    from quire import session

    class Bare:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Bare, "x")


def test_one_file_is_written_by_many_tasks(spark, scratch):
    """The parts of a large file have tasks of their own; none handles all rows."""
    from pyspark.sql import functions as F
    from quire.plans.load_queries import _one_file
    from quire.schemas import PAPER_COLUMNS
    papers = spark.range(1, 2001, numPartitions=4).select(
        F.col("id").alias("seq"), *[F.concat(F.lit(f'{c} "'), F.col("id"), F.lit('"\nx')).alias(c) for c in PAPER_COLUMNS if c != "extracted_at"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("one-file", "")
    try:
        _one_file(spark, papers.repartition(3), f"{scratch}/drops/all papers.csv")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("one-file") for s in status.getJobInfo(j).stageIds
             if status.getStageInfo(s)]
    assert min(tasks) > 1
    with open(f"{scratch}/drops/all papers.csv", encoding="utf-8", newline="") as f:
        text = f.read()
    row = lambda i: ",".join('"2024-01-01 00:00:00"' if c == "extracted_at" else f'"{c} ""{i}""\nx"' for c in PAPER_COLUMNS)
    assert text == "\n".join([",".join(PAPER_COLUMNS), *map(row, range(1, 2001))]) + "\n"


def test_blocks_of_a_large_file_are_no_more_than_tasks_can_take():
    from quire.plans.load_queries import BLOCK, MOST_BLOCKS, block_size
    assert block_size(0) == block_size(BLOCK * MOST_BLOCKS) == BLOCK
    for length in (1 << 30, 10 << 30, (60 << 30) + 1):
        assert -(-length // block_size(length)) <= MOST_BLOCKS < length // BLOCK
