"""Registered queries for the load side: date/number typing, width caps,
column back-fill, CSV round trip, per-file load results, numbering."""

from __future__ import annotations

import os
import shutil
from contextlib import contextmanager

from pyspark.sql import functions as F

from quire.functions.dates import parse_int, parse_pub_date, parse_timestamp
from quire.functions.text import WHITESPACE_CLASS
from quire.operators import clean as C
from quire.operators.seq import assign_seq
from quire.plans.catalog import register
from quire.plans.fixtures import PAPERS_FX_SQL, papers_fx, table, with_views
from quire.plans.load_run import clean_drops, run_load
from quire.schemas import PAPER_COLUMNS, WIDTHS
from quire.session import drop_scratch, scratch_path
from quire.sources.drops import list_drops
from quire.sources.sinks import write_drop
from quire.sources.tables import read_load_log, read_papers

WS = WHITESPACE_CLASS


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


# DuckDB form of the publication-date rules (quire.functions.dates).
def pub_date_sql(col: str) -> str:
    r = _strip_sql(col)
    return f"""CASE
  WHEN regexp_full_match({r}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime({r}, '%Y-%m-%d') IS NOT NULL
    THEN cast(try_strptime({r}, '%Y-%m-%d') AS date)
  WHEN length({r}) = 7 AND regexp_full_match({r}, '[0-9]{{4}}-[0-9]{{2}}')
    THEN cast(try_strptime({r} || '-01', '%Y-%m-%d') AS date)
  WHEN length({r}) = 4 AND regexp_full_match({r}, '[0-9]{{4}}') AND cast({r} AS int) BETWEEN 1900 AND 2100
    THEN make_date(cast({r} AS int), 1, 1)
  WHEN regexp_full_match({r}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN cast(try_strptime({r}, '%Y-%m-%d') AS date)
  WHEN regexp_full_match({r}, '[0-9]{{4}}-[0-9]{{1,2}}') THEN cast(try_strptime({r} || '-1', '%Y-%m-%d') AS date)
  WHEN regexp_full_match({r}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN cast(try_strptime({r}, '%Y/%m/%d') AS date)
  WHEN regexp_full_match({r}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN cast(try_strptime({r}, '%m/%d/%Y') AS date)
  WHEN regexp_full_match({r}, '[0-9]{{1,2}} [A-Za-z]+ [0-9]{{4}}')
    THEN cast(coalesce(try_strptime({r}, '%d %B %Y'), try_strptime({r}, '%d %b %Y')) AS date)
  WHEN regexp_full_match({r}, '[A-Za-z]+ [0-9]{{4}}')
    THEN cast(coalesce(try_strptime('1 ' || {r}, '%d %B %Y'), try_strptime('1 ' || {r}, '%d %b %Y')) AS date)
  WHEN regexp_full_match({r}, '[A-Za-z]+ [0-9]{{1,2}}, [0-9]{{4}}')
    THEN cast(coalesce(try_strptime({r}, '%B %d, %Y'), try_strptime({r}, '%b %d, %Y')) AS date)
  WHEN regexp_matches({r}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}')
    THEN cast(try_strptime(left({r}, 10), '%Y-%m-%d') AS date)
END"""


# Raw date text in ten shapes, chosen by o_orderkey % 10.
_RAW_DATE_SQL = """CASE o_orderkey % 10
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
  WHEN 2 THEN strftime(o_orderdate, '%Y')
  WHEN 3 THEN strftime(o_orderdate, '%Y-%-m-%-d')
  WHEN 4 THEN strftime(o_orderdate, '%-d %B %Y')
  WHEN 5 THEN ' ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z '
  WHEN 6 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 7 THEN strftime(o_orderdate, '%b %Y')
  WHEN 8 THEN strftime(o_orderdate, '%B %-d, %Y')
  ELSE CASE WHEN o_custkey % 2 = 0 THEN 'None' ELSE cast(1800 + o_custkey % 100 AS varchar) END
END"""


def _raw_date(o):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 10
    return (F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 1, F.date_format(d, "yyyy-MM"))
            .when(k == 2, F.date_format(d, "yyyy"))
            .when(k == 3, F.date_format(d, "yyyy-M-d"))
            .when(k == 4, F.date_format(d, "d MMMM yyyy"))
            .when(k == 5, F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z ")))
            .when(k == 6, F.date_format(d, "MM/dd/yyyy"))
            .when(k == 7, F.date_format(d, "MMM yyyy"))
            .when(k == 8, F.date_format(d, "MMMM d, yyyy"))
            .otherwise(F.when(F.col("o_custkey") % 2 == 0, F.lit("None"))
                       .otherwise((F.lit(1800) + F.col("o_custkey") % 100).cast("string"))))


@register("publication_dates", f"""
SELECT o_orderkey, raw, {pub_date_sql('raw')} AS published_date
FROM (SELECT o_orderkey, {_RAW_DATE_SQL} AS raw FROM orders)""")
def publication_dates(spark, sf_dir):
    """Publication-date typing (J41) over date text in ten shapes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", _raw_date(None).alias("raw"))
    return o.select("o_orderkey", "raw", parse_pub_date(F.col("raw")).alias("published_date"))


_RAW_CITES_SQL = """CASE WHEN doc_id % 11 = 0 THEN 'n/a'
  WHEN doc_id % 13 = 0 THEN ' +' || cast(n_chars % 100 AS varchar) || ' '
  WHEN doc_id % 17 = 0 THEN '99999999999'
  WHEN doc_id % 19 = 0 THEN cast(n_chars % 100 AS varchar) || '.0'
  ELSE cast(n_chars AS varchar) END"""
_RAW_TS_SQL = """CASE WHEN doc_id % 5 = 0 THEN 'yesterday'
  WHEN doc_id % 5 = 1 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37), '%Y-%m-%dT%H:%M:%S')
  WHEN doc_id % 5 = 2 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37), '%Y-%m-%d %H:%M:%S.250')
  WHEN doc_id % 5 = 3 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37), '%Y-%m-%dT%H:%M:%S+02:00')
  ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37), '%Y-%m-%d %H:%M:%S') END"""


def _ts_sql(r: str) -> str:
    s = _strip_sql(r)
    return f"""coalesce(try_strptime({s}, '%Y-%m-%d %H:%M:%S'), try_strptime({s}, '%Y-%m-%dT%H:%M:%S'),
  try_strptime({s}, '%Y-%m-%d %H:%M'), try_strptime({s}, '%Y-%m-%d'), try_strptime({s}, '%Y/%m/%d %H:%M:%S'),
  try_strptime({s}, '%Y-%m-%d %H:%M:%S.%g'),
  try_strptime(left({s}, 19), '%Y-%m-%dT%H:%M:%S') - to_hours(try_cast(substr({s}, 21, 2) AS bigint)))"""


@register("type_columns", f"""
SELECT doc_id, raw_cites, raw_ts,
  CASE WHEN regexp_full_match({_strip_sql('raw_cites')}, '[+-]?[0-9]+')
       THEN try_cast({_strip_sql('raw_cites')} AS int) END AS citation_count,
  {_ts_sql('raw_ts')} AS extracted_at
FROM (SELECT doc_id, {_RAW_CITES_SQL} AS raw_cites, {_RAW_TS_SQL} AS raw_ts FROM documents)""")
def type_columns(spark, sf_dir):
    """Integer and timestamp typing (J42): bad text, overflow -> NULL; plain,
    fractional and zoned timestamps."""
    doc = F.col("doc_id")
    n = F.col("n_chars")
    raw_cites = (F.when(doc % 11 == 0, F.lit("n/a"))
                 .when(doc % 13 == 0, F.concat(F.lit(" +"), (n % 100).cast("string"), F.lit(" ")))
                 .when(doc % 17 == 0, F.lit("99999999999"))
                 .when(doc % 19 == 0, F.concat((n % 100).cast("string"), F.lit(".0")))
                 .otherwise(n.cast("string")))
    ts = F.timestamp_add("SECOND", doc * 37, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    raw_ts = (F.when(doc % 5 == 0, F.lit("yesterday"))
              .when(doc % 5 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
              .when(doc % 5 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss'.250'"))
              .when(doc % 5 == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
              .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    d = table(spark, sf_dir, "documents").select("doc_id", raw_cites.alias("raw_cites"),
                                                raw_ts.alias("raw_ts"))
    return d.select("doc_id", "raw_cites", "raw_ts",
                    parse_int(F.col("raw_cites")).alias("citation_count"),
                    parse_timestamp(F.col("raw_ts")).alias("extracted_at"))


_CAP_COLS = ["url", "site_name", "keyword", "paper_number", "title", "doi", "journal", "authors"]


@register("cap_widths", "SELECT doc_id, " + ", ".join(
    f"left(text, {WIDTHS[c]}) AS {c}" if c in WIDTHS else f"text AS {c}" for c in _CAP_COLS)
    + " FROM documents")
def cap_widths(spark, sf_dir):
    """Width caps (J44): every text column filled with the whole document."""
    d = table(spark, sf_dir, "documents").select("doc_id", *[F.col("text").alias(c) for c in _CAP_COLS])
    return C.cap_widths(d)


@register("cap_width_counts", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE length(text) > {n}) AS cut_{c}" for c, n in WIDTHS.items())
    + " FROM documents")
def cap_width_counts(spark, sf_dir):
    """How many values each cap cuts (J44 report)."""
    d = table(spark, sf_dir, "documents").select(*[F.col("text").alias(c) for c in WIDTHS])
    return C.truncation_counts(d)


_OLD = ("keyword", "doi", "abstract", "citation_count", "journal")


@register("conform_columns", with_views(PAPERS_FX_SQL) + """
SELECT seq, url, site_name, paper_number, title, authors,
  CASE WHEN site_name IN ('src1', 'src5') THEN NULL ELSE coalesce(keyword, '') END AS keyword,
  CASE WHEN site_name IN ('src1', 'src5') THEN NULL ELSE coalesce(doi, '') END AS doi,
  CASE WHEN site_name IN ('src1', 'src5') THEN NULL ELSE coalesce(abstract, '') END AS abstract,
  CASE WHEN site_name IN ('src1', 'src5') THEN NULL ELSE coalesce(journal, '') END AS journal
FROM papers_fx""")
def conform_columns(spark, sf_dir):
    """Back-fill and empty-versus-NULL (J40, J43) on parsed rows: the rows of
    two sites carry an old header (their header list lacks the optional
    columns), and empty fields arrive as NULL, as the CSV reader gives them."""
    p = papers_fx(spark, sf_dir)
    old = F.col("site_name").isin("src1", "src5")
    full = F.array(*[F.lit(c) for c in PAPER_COLUMNS])
    short = F.array(*[F.lit(c) for c in PAPER_COLUMNS if c not in _OLD])
    text = p.select("seq", *[
        (F.when(~old, F.col(c)) if c in _OLD else F.col(c)).cast("string").alias(c)
        for c in PAPER_COLUMNS if c != "extracted_at"],
        F.lit(None).cast("string").alias("extracted_at"),
        F.when(old, short).otherwise(full).alias("present"))
    # a reader gives NULL for an empty field: model that before conforming
    text = text.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if c in PAPER_COLUMNS else F.col(c)
                         for c in text.columns])
    return C.conform(text).select("seq", "url", "site_name", "paper_number", "title", "authors",
                                  "keyword", "doi", "abstract", "journal")


_RT_COLS = ["url", "site_name", "keyword", "paper_number", "title", "authors", "published_date",
            "doi", "abstract", "citation_count", "journal"]


@register("csv_round_trip", with_views(PAPERS_FX_SQL) + """
SELECT url, site_name, keyword, paper_number, title, authors, published_date,
       coalesce(doi, '') AS doi, coalesce(abstract, '') AS abstract, citation_count,
       coalesce(journal, '') AS journal
FROM papers_fx""")
def csv_round_trip(spark, sf_dir):
    """Write the papers as a CSV drop (J06), read it back with the
    header-aware scan and clean/type it (J02, J40-J44)."""
    p = papers_fx(spark, sf_dir).select(
        *[F.col(c).cast("string").alias(c) if c in ("published_date",) else F.col(c)
          for c in PAPER_COLUMNS if c != "extracted_at"], F.lit("").alias("extracted_at"))
    drop = write_drop(p, scratch_path(spark, "drops"), "roundtrip", max_records_per_file=250)
    return clean_drops(spark, drop).select(*_RT_COLS)


@register("load_results", with_views(PAPERS_FX_SQL) + """
SELECT site_name AS drop_key, cast(count(*) AS int) AS total_rows, cast(count(*) AS int) AS loaded_rows,
       0 AS failed_rows, 'SUCCESS' AS status
FROM papers_fx GROUP BY site_name""")
def load_results(spark, sf_dir):
    """A full load cycle (J02-J10, J40-J47) over drops written one folder per
    site, loaded files archived afterwards; the log rows of a site's files are
    summed."""
    root = scratch_path(spark, "load")
    p = papers_fx(spark, sf_dir).withColumn("drop", F.col("site_name"))
    (p.select(*[F.col(c).cast("string") for c in PAPER_COLUMNS if c != "extracted_at"],
              F.lit("2024-01-01 00:00:00").alias("extracted_at"), "drop")
     .write.partitionBy("drop").option("header", True).option("maxRecordsPerFile", 20_000)
     .option("quoteAll", True).option("escape", '"').csv(f"{root}/drops"))
    out = run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log",
                   archive_dir=f"{root}/archive")
    return out.log.groupBy(F.regexp_extract("file_name", r"drop=([^/]+)/", 1).alias("drop_key")).agg(
        *[F.sum(c).cast("int").alias(c) for c in ("total_rows", "loaded_rows", "failed_rows")],
        F.max("status").alias("status"))


_STORED_SQL = with_views(PAPERS_FX_SQL) + """
SELECT url, site_name, keyword, paper_number, title, authors, published_date,
       coalesce(doi, '') AS doi, coalesce(abstract, '') AS abstract, citation_count, coalesce(journal, '') AS journal,
       TIMESTAMP '2024-01-01 00:00:00' AS extracted_at
FROM papers_fx"""


def _drop_rows(papers):
    """Papers as the text of a drop."""
    return papers.select(*[F.col(c).cast("string") for c in PAPER_COLUMNS if c != "extracted_at"],
                         F.lit("2024-01-01 00:00:00").alias("extracted_at"))


def _land(spark, papers, drops: str, columns=None) -> None:
    """Drop files ``drop-00000.csv``, ... directly in the folder, under the
    same names whenever something lands."""
    from quire.sources.drops import file_system
    tmp = scratch_path(spark, "landing")
    rows = _drop_rows(papers)
    (rows.select(*columns) if columns else rows).write.option("header", True).option("quoteAll", True) \
        .option("escape", '"').option("maxRecordsPerFile", 20_000) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(tmp)
    fs, root = file_system(spark, drops)
    fs.mkdirs(root)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts = sorted(s.getPath().toString() for s in fs.globStatus(new(f"{tmp}/part-*")))
    for i, part in enumerate(parts):
        fs.rename(new(part), new(root, f"drop-{i:05d}.csv"))


@register("loaded_papers", _STORED_SQL)
def loaded_papers(spark, sf_dir):
    """The stored rows after a load cycle (J08), typed and read back."""
    root = scratch_path(spark, "load")
    write_drop(_drop_rows(papers_fx(spark, sf_dir)), f"{root}/drops", "b1")
    run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    return read_papers(spark, f"{root}/papers").select(*PAPER_COLUMNS)


@register("loaded_whole_titles", "SELECT doc_id AS n, left(text, 2000) AS title, text AS abstract FROM documents")
def loaded_whole_titles(spark, sf_dir):
    """Whole texts as titles through a load (J44): the stored width cuts them."""
    root = scratch_path(spark, "load")
    p = papers_fx(spark, sf_dir).withColumns({"title": F.col("abstract"), "citation_count": F.col("seq") - 1})
    write_drop(_drop_rows(p), f"{root}/drops", "b1")
    run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    return read_papers(spark, f"{root}/papers").select(F.col("citation_count").cast("bigint").alias("n"),
                                                       "title", "abstract")


@register("load_redropped_names", _STORED_SQL)
def load_redropped_names(spark, sf_dir):
    """New files under names that were loaded before (J03, J08, J10): half of
    the papers land, load and go to an archive inside the drop folder; the
    other half lands under the same names. A last cycle finds nothing."""
    root = scratch_path(spark, "load")
    p = papers_fx(spark, sf_dir)
    for half in (0, 1):
        _land(spark, p.where(F.col("seq") % 2 == half), f"{root}/drops")
        run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log", archive_dir=f"{root}/drops/archive")
    run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log", archive_dir=f"{root}/drops/archive")
    return read_papers(spark, f"{root}/papers").select(*PAPER_COLUMNS)


@register("load_after_log_failure", _STORED_SQL)
def load_after_log_failure(spark, sf_dir):
    """A log that cannot be written in the first cycle (J09), more files before
    the second: every paper is stored once, although the first files load
    again, being in no log."""
    root = scratch_path(spark, "load")
    p = papers_fx(spark, sf_dir)
    write_drop(_drop_rows(p.where("seq % 3 = 0")), f"{root}/drops", "b1")
    blocked = _blocked_path(spark, f"{root}/blocked")
    run_load(spark, f"{root}/drops", f"{root}/papers", blocked)
    write_drop(_drop_rows(p.where("seq % 3 <> 0")), f"{root}/drops", "a0")
    run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    return read_papers(spark, f"{root}/papers").select(*PAPER_COLUMNS)


def _blocked_path(spark, path: str) -> str:
    """A path below a file, where no table can be written."""
    from quire.sources.drops import file_system
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    fs.createNewFile(p)
    return f"{path}/log"


@register("load_failing_cycles", with_views(PAPERS_FX_SQL) + """
SELECT 'FAILED' AS status, cast(0 AS bigint) AS rows, cast(2 AS bigint) AS failures
UNION ALL SELECT 'SUCCESS', count(*), 0 FROM papers_fx""")
def load_failing_cycles(spark, sf_dir):
    """An empty file beside good ones in two cycles (J09, J45): it is logged
    FAILED in each of them, and no log row replaces another."""
    from quire.sources.drops import file_system
    root = scratch_path(spark, "load")
    write_drop(_drop_rows(papers_fx(spark, sf_dir)), f"{root}/drops", "b1")
    fs, p = file_system(spark, f"{root}/drops/empty.csv")
    fs.createNewFile(p)
    for _ in range(2):
        run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    return read_load_log(spark, f"{root}/log").groupBy("status").agg(
        F.sum("loaded_rows").alias("rows"), F.count_if(F.col("error_msg").isNotNull()).alias("failures"))


@register("load_wide_drops", _STORED_SQL)
def load_wide_drops(spark, sf_dir):
    """Drops with 60 unknown columns before ours."""
    root = scratch_path(spark, "load")
    _land(spark, papers_fx(spark, sf_dir), f"{root}/drops",
          [*[F.lit(str(i)).alias(f"extra{i}") for i in range(60)], *PAPER_COLUMNS])
    run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    return read_papers(spark, f"{root}/papers").select(*PAPER_COLUMNS)


def _ragged_lines(spark, sf_dir, drops: str) -> None:
    """One file per site, a header and a line per paper in the order of seq;
    every tenth paper lacks its last fields."""
    p = papers_fx(spark, sf_dir)
    line = F.concat_ws(",", "site_name", "paper_number", *[F.when(F.col("seq") % 10 != 0, F.lit(v)) for v in ("t", "u")])
    _sites_as_files(spark, p.select("site_name", "seq", line.alias("value")), ["site_name", "paper_number", "title", "url"], drops)


def _sites_as_files(spark, rows, names: list[str], drops: str) -> None:
    """One file per site with a header and its lines (``value``) in the order of seq."""
    heads = rows.select("site_name").distinct().select("site_name", F.lit(-1).cast("bigint").alias("seq"),
                                                       F.lit(",".join(names)).alias("value"))
    (rows.unionByName(heads).repartitionByRange("site_name").sortWithinPartitions("site_name", "seq")
     .select("value", F.col("site_name").alias("drop")).write.partitionBy("drop").text(f"{drops}_txt"))
    from quire.sources.drops import file_system
    fs, root = file_system(spark, drops)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(root)
    for s in fs.globStatus(new(f"{drops}_txt/drop=*/part-*")):  # one per site
        fs.rename(s.getPath(), new(root, f"{s.getPath().getParent().getName()}.csv"))


@register("load_partial_files", with_views(PAPERS_FX_SQL) + """
SELECT site_name AS drop_key, cast(count(*) AS int) AS total_rows,
       cast(count(*) FILTER (WHERE seq % 10 <> 0) AS int) AS loaded_rows,
       cast(count(*) FILTER (WHERE seq % 10 = 0) AS int) AS failed_rows,
       CASE WHEN count(*) FILTER (WHERE seq % 10 = 0) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
       TRUE AS in_order
FROM papers_fx GROUP BY site_name""")
def load_partial_files(spark, sf_dir):
    """Short rows rejected (J45, J45f): PARTIAL files with their counts, each
    with its own start and end."""
    root = scratch_path(spark, "load")
    _ragged_lines(spark, sf_dir, f"{root}/drops")
    log = run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log", on_ragged="reject").log
    return log.select(F.regexp_extract("file_name", r"drop=([^/]+)[.]csv$", 1).alias("drop_key"),
                      "total_rows", "loaded_rows", "failed_rows", "status",
                      (F.col("started_at") <= F.col("finished_at")).alias("in_order"))


@register("loaded_seq", with_views(PAPERS_FX_SQL) + """
SELECT site_name, paper_number, row_number() OVER (ORDER BY site_name, seq) AS seq FROM papers_fx WHERE seq % 10 <> 0""")
def loaded_seq(spark, sf_dir):
    """Numbers given by a load (J47): file order, then the order of the rows
    inside a file, without gaps for rejected rows."""
    root = scratch_path(spark, "load")
    _ragged_lines(spark, sf_dir, f"{root}/drops")
    run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log", on_ragged="reject")
    return read_papers(spark, f"{root}/papers").select("site_name", "paper_number", "seq")


#: Bytes of the smallest block of a file that many tasks read, and the most such blocks.
BLOCK, MOST_BLOCKS = 128 << 10, 1024


def block_size(length: int) -> int:
    """The block of a file of so many bytes. Each block is a task, read twice, with a
    row for the driver: small ones show that a file is split, but a large file gets larger ones."""
    return max(BLOCK, -(-length // MOST_BLOCKS))


@contextmanager
def small_blocks(spark, size: int | str = BLOCK):
    """Files are split into blocks of ``size`` bytes while the jobs inside run."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(size))
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def _one_file(spark, papers, path: str) -> None:
    """All papers, in order of seq, as one file of many lines a record: each
    part is written by its own task and put in its place in the file, in a
    folder that executors share by its own task, else by the store (``concat``)."""
    from quire.sources.drops import file_system
    tmp = scratch_path(spark, "landing")
    rows = papers.withColumn("extracted_at", F.lit("2024-01-01 00:00:00")).select(
        "seq", *[F.col(c).cast("string") for c in PAPER_COLUMNS])
    fields = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in PAPER_COLUMNS]
    head = spark.createDataFrame([(0, ",".join(PAPER_COLUMNS))], "seq bigint, value string")
    lines = rows.select("seq", F.concat_ws(",", *fields).alias("value")).unionByName(head)
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(tmp)
    fs, to = file_system(spark, path)
    fs.mkdirs(to.getParent())
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts = sorted((s.getPath().toString(), s.getLen()) for s in fs.globStatus(new_path(f"{tmp}/part-*")) if s.getLen())
    if fs.getUri().getScheme() != "file":  # the store puts files together itself
        first, *rest = (new_path(p) for p, _ in parts)
        fs.rename(first, to)
        array = spark.sparkContext._gateway.new_array(new_path, len(rest))
        for i, p in enumerate(rest):
            array[i] = p
        if rest:
            fs.concat(to, array)
    else:
        given, at, target = [], 0, to.toUri().getPath()
        for p, size in parts:
            given.append((new_path(p).toUri().getPath(), at))
            at += size

        def put(part):
            with open(part[0], "rb") as src, open(os.open(target, os.O_WRONLY | os.O_CREAT), "wb") as out:
                out.seek(part[1])
                shutil.copyfileobj(src, out, 1 << 23)
        spark.sparkContext.parallelize(given, len(given)).foreach(put)
    drop_scratch(spark, tmp)


@register("load_one_large_file", with_views(PAPERS_FX_SQL) + """
SELECT row_number() OVER (ORDER BY seq) AS seq, url, left(title, 2000) AS title, abstract, published_date,
       citation_count, coalesce(journal, '') AS journal FROM papers_fx""")
def load_one_large_file(spark, sf_dir):
    """All papers in one file with line feeds inside the fields (J02, J47), read
    by many tasks: rows and numbers are those of a read by one task."""
    root = scratch_path(spark, "load")
    _one_file(spark, papers_fx(spark, sf_dir), f"{root}/drops/all papers.csv")
    with small_blocks(spark, block_size(sum(f.length for f in list_drops(spark, f"{root}/drops")))):
        run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    return read_papers(spark, f"{root}/papers").select("seq", "url", "title", "abstract", "published_date",
                                                       "citation_count", "journal")


@register("load_text_after_quotes", with_views(PAPERS_FX_SQL) + """
SELECT site_name, paper_number, concat('"T', cast(seq AS varchar), '" and more') AS title, concat('u"', site_name) AS url
FROM papers_fx""")
def load_text_after_quotes(spark, sf_dir):
    """Malformed quotes (J02): text after a closing quote, and a quote inside an
    unquoted field, stay in their fields; the row loads."""
    root = scratch_path(spark, "load")
    p = papers_fx(spark, sf_dir)
    line = F.concat_ws(",", "site_name", F.concat(F.lit('"T'), F.col("seq"), F.lit('" and more')),
                       F.concat(F.lit('u"'), F.col("site_name")), "paper_number")
    _sites_as_files(spark, p.select("site_name", "seq", line.alias("value")), ["site_name", "title", "url", "paper_number"],
                    f"{root}/drops")
    run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    return read_papers(spark, f"{root}/papers").select("site_name", "paper_number", "title", "url")


@register("load_header_only_files", with_views(PAPERS_FX_SQL) + """
SELECT site_name AS drop_key, cast(count(*) AS int) AS total_rows, 'SUCCESS' AS status, 1 AS cycles_logged
FROM papers_fx WHERE site_name <> 'src1' GROUP BY site_name""")
def load_header_only_files(spark, sf_dir):
    """Files without data rows (J46) beside others, in two cycles: they get no
    log row, and load when rows have come."""
    root = scratch_path(spark, "load")
    p = papers_fx(spark, sf_dir)
    line = F.when(F.col("site_name") != "src1", F.concat_ws(",", "site_name", "paper_number", "url"))
    _sites_as_files(spark, p.select("site_name", "seq", line.alias("value")).where("value is not null").unionByName(
        p.where("site_name = 'src1'").select("site_name", F.lit(-2).cast("bigint").alias("seq"), F.lit("").alias("value"))
        .distinct()), ["site_name", "paper_number", "url"], f"{root}/drops")
    for _ in range(2):
        run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log")
    log = read_load_log(spark, f"{root}/log")
    return log.groupBy(F.regexp_extract("file_name", r"drop=([^/]+)[.]csv$", 1).alias("drop_key")).agg(
        F.sum("total_rows").cast("int").alias("total_rows"), F.max("status").alias("status"),
        F.count("*").cast("int").alias("cycles_logged"))


@register("papers_before_later_columns", with_views(PAPERS_FX_SQL) + """
SELECT seq, url, title, CASE WHEN seq % 2 = 0 THEN keyword END AS keyword, CASE WHEN seq % 2 = 0 THEN doi END AS doi,
       CASE WHEN seq % 2 = 0 THEN abstract END AS abstract, CASE WHEN seq % 2 = 0 THEN citation_count END AS citation_count
FROM papers_fx""")
def papers_before_later_columns(spark, sf_dir):
    """A table whose older partitions lack the four later columns (J05, J48):
    they read as NULL there."""
    path = f"{scratch_path(spark, 'load')}/papers"
    p = papers_fx(spark, sf_dir).withColumns({"loaded_at": F.lit("2024-01-01").cast("timestamp_ntz"),
                                              "extracted_at": F.lit(None).cast("timestamp_ntz")})
    later = ["keyword", "doi", "abstract", "citation_count"]
    p.where("seq % 2 = 1").drop(*later).write.parquet(f"{path}/file_id=a")
    p.where("seq % 2 = 0").write.parquet(f"{path}/file_id=b")
    return read_papers(spark, path).select("seq", "url", "title", *later)


@register("assign_seq", """
SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS seq FROM documents""")
def assign_seq_query(spark, sf_dir):
    """Contiguous surrogate keys in (source, doc_id) order."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return assign_seq(d, ["source", "doc_id"], 0)


_SITE_DATE_SQL = """CASE doc_id % 6
  WHEN 0 THEN '2021-0' || cast(1 + doc_id % 9 AS varchar) || '-1' || cast(doc_id % 10 AS varchar)
  WHEN 1 THEN 'Spring ' || cast(2000 + doc_id % 25 AS varchar)
  WHEN 2 THEN cast(1890 + doc_id % 20 AS varchar)
  WHEN 3 THEN ''
  WHEN 4 THEN cast(doc_id % 28 + 1 AS varchar) || ' March 2020'
  ELSE '2020-13-01' END"""


@register("unparsed_dates", f"""
SELECT source AS site_name,
       count(*) FILTER (WHERE length({_strip_sql('raw')}) > 0) AS dated_rows,
       count(*) FILTER (WHERE length({_strip_sql('raw')}) > 0 AND ({pub_date_sql('raw')}) IS NULL) AS unparsed_dates
FROM (SELECT source, {_SITE_DATE_SQL} AS raw FROM documents) GROUP BY source""")
def unparsed_dates(spark, sf_dir):
    """Per-site count of date text no rule can type (J41 report)."""
    doc = F.col("doc_id")
    k = doc % 6
    raw = (F.when(k == 0, F.concat(F.lit("2021-0"), (1 + doc % 9).cast("string"), F.lit("-1"),
                                   (doc % 10).cast("string")))
           .when(k == 1, F.concat(F.lit("Spring "), (2000 + doc % 25).cast("string")))
           .when(k == 2, (1890 + doc % 20).cast("string"))
           .when(k == 3, F.lit(""))
           .when(k == 4, F.concat((doc % 28 + 1).cast("string"), F.lit(" March 2020")))
           .otherwise(F.lit("2020-13-01")))
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("site_name"),
                                                raw.alias("published_date"))
    return C.unparsed_dates_by_site(d)


@register("assign_seq_skewed", """
SELECT lang, doc_id, row_number() OVER (ORDER BY lang, doc_id) AS seq FROM documents""")
def assign_seq_skewed(spark, sf_dir):
    """Numbering (J47) with a hot leading key: about 60% of the documents are
    'en'; range bounds on (lang, doc_id) still spread that group over tasks."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return assign_seq(d, ["lang", "doc_id"], 0)
