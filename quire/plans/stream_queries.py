"""Registered queries that run the Structured Streaming jobs to completion
(availableNow) over landed copies of the test tables and read the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans import payload_fixtures as PF
from quire.plans.catalog import register
from quire.plans.fixtures import PAPERS_FX_SQL, papers_fx, table, with_views
from quire.plans.harvest_queries import RAW_COLUMNS, _harvest_ctes
from quire.plans.load_queries import _blocked_path, _land, _ts_sql, pub_date_sql
from quire.plans.source_queries import AB_SQL, BASE_SQL
from quire.schemas import PAPER_COLUMNS
from quire.session import scratch_path
from quire.sources import normalisers as N
from quire.sources.payloads import land_raw_responses, stream_raw_responses
from quire.sources.sinks import write_drop
from quire.sources.tables import read_papers
from quire.streaming.common import run_available
from quire.streaming.cycle import run_cycle
from quire.streaming.dedup_stream import dedup_stream, first_arrivals, read_first_arrivals
from quire.streaming.harvest_stream import harvest_stream
from quire.streaming.load_stream import load_stream


@register("stream_dedup", "SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Streaming dropDuplicates on (event_type, user_id) over events landed
    as several files, one micro-batch each (J82); keys are compared."""
    root = scratch_path(spark, "stream-dedup")
    ev = table(spark, sf_dir, "events")
    ev.repartition(4).write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    out = dedup_stream(stream, ["event_type", "user_id"])
    run_available(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out").select("event_type", "user_id")


@register("stream_first_arrival", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def stream_first_arrival(spark, sf_dir):
    """First arrival per key (J82) as a stream, all columns: events land in four
    files out of order, one micro-batch each, half of them after a restart."""
    root = scratch_path(spark, "stream-first")
    ev = table(spark, sf_dir, "events")
    keys, order = ["event_type", "user_id"], ["ts", "event_id"]
    for part in (1, 0):
        (ev.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).repartition(2, "event_id")
         .write.mode("append").parquet(f"{root}/landing"))
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
        first_arrivals(stream, keys, order, f"{root}/out", f"{root}/ckpt")
    return read_first_arrivals(spark, f"{root}/out", ev.schema, keys, order)


@register("stream_load", with_views(PAPERS_FX_SQL) + """
SELECT url, site_name, keyword, paper_number, title, authors, published_date,
       coalesce(doi, '') AS doi, citation_count, coalesce(journal, '') AS journal
FROM papers_fx""")
def stream_load(spark, sf_dir):
    """Drop-folder stream (J80): several drop files, two per load, loaded
    into the paper table; the stored rows are read back."""
    root = scratch_path(spark, "stream-load")
    p = papers_fx(spark, sf_dir).select(
        *[F.col(c).cast("string") for c in PAPER_COLUMNS if c != "extracted_at"],
        F.lit("2024-01-01 00:00:00").alias("extracted_at"))
    write_drop(p.repartition(max(4, spark.sparkContext.defaultParallelism)), f"{root}/drops", "b1")
    load_stream(spark, f"{root}/drops", f"{root}/papers", f"{root}/log", f"{root}/ckpt",
                max_files_per_trigger=2)
    return read_papers(spark, f"{root}/papers").select(
        "url", "site_name", "keyword", "paper_number", "title", "authors", "published_date",
        "doi", "citation_count", "journal")


def _land_payloads(spark, sf_dir, root, part):
    """Half of the responses, by keyword; each keyword's land together."""
    pay = PF.mixed_payloads(spark, sf_dir, N.SOURCES)
    half = pay.where(F.col("keyword_idx") < 10 if part == 0 else F.col("keyword_idx") >= 10)
    half.write.parquet(f"{root}/landing/part{part}")
    return f"{root}/landing/*"


_STREAM_KEYS_SQL = BASE_SQL + AB_SQL + _harvest_ctes("s", "TRUE", None) + """
SELECT DISTINCT site_name, paper_number FROM s_first"""


@register("stream_harvest", BASE_SQL + AB_SQL + _harvest_ctes("s", "TRUE", None) + "\nSELECT "
          + ", ".join(f"coalesce(cast({c} AS varchar), '') AS {c}" for c in PAPER_COLUMNS) + " FROM s_first")
def stream_harvest(spark, sf_dir):
    """Harvest stream (J81): two landings, a start of the stream after each;
    the second batch is deduped against the ledger that the first one wrote.
    The drops, all columns, are those of one batch run."""
    root = scratch_path(spark, "stream-harvest")
    for part in (0, 1):
        landing = _land_payloads(spark, sf_dir, root, part)
        harvest_stream(spark, landing, f"{root}/ledger", f"{root}/drops", f"{root}/pending", f"{root}/ckpt")
    drops = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .csv(f"{root}/drops")
    return drops.select(*[F.coalesce(c, F.lit("")).alias(c) for c in PAPER_COLUMNS])


@register("stream_harvest_raw", BASE_SQL + AB_SQL + _harvest_ctes("s", "TRUE", None) + "\nSELECT "
          + ", ".join(f"coalesce(cast({c} AS varchar), '') AS {c}" for c in RAW_COLUMNS) + " FROM s_first")
def stream_harvest_raw(spark, sf_dir):
    """Harvest stream (J81) over raw response files (J01), started twice: the
    keywords of a first landing, then the others, which land beside them."""
    root = scratch_path(spark, "stream-raw")
    pay = PF.mixed_payloads(spark, sf_dir, N.SOURCES)
    keywords = [f"kw{i}" for i in range(20)]
    for half in (F.col("keyword_idx") < 10, F.col("keyword_idx") >= 10):
        land_raw_responses(pay.where(half), f"{root}/raw")
        raw = stream_raw_responses(spark, f"{root}/raw", keywords, N.SOURCES, list(range(20)))
        harvest_stream(spark, None, f"{root}/ledger", f"{root}/drops", f"{root}/pending", f"{root}/ckpt", stream=raw)
    drops = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{root}/drops")
    return drops.select(*[F.coalesce(c, F.lit("")).alias(c) for c in RAW_COLUMNS])


@register("stream_cycle", _STREAM_KEYS_SQL)
def stream_cycle(spark, sf_dir):
    """Full cycle (J83): harvest stream, then the load stream over its drops;
    the keys in the paper table are compared with one batch harvest."""
    root = scratch_path(spark, "stream-cycle")
    for part in (0, 1):
        run_cycle(spark, root, _land_payloads(spark, sf_dir, root, part))
    return read_papers(spark, f"{root}/papers").select("site_name", "paper_number")


@register("stream_cycle_columns", BASE_SQL + AB_SQL + _harvest_ctes("s", "TRUE", None) + f"""
SELECT left(url, 1000) AS url, left(site_name, 100) AS site_name, left(coalesce(keyword, ''), 500) AS keyword,
       left(paper_number, 200) AS paper_number, left(title, 2000) AS title, authors,
       {pub_date_sql("cast(published_date AS varchar)")} AS published_date, left(coalesce(doi, ''), 500) AS doi,
       coalesce(abstract, '') AS abstract, cast(citation_count AS int) AS citation_count,
       left(coalesce(journal, ''), 500) AS journal, {_ts_sql("cast(extracted_at AS varchar)")} AS extracted_at
FROM s_first""")
def stream_cycle_columns(spark, sf_dir):
    """Full cycle (J83), all twelve stored columns, after two landings."""
    root = scratch_path(spark, "stream-cycle")
    for part in (0, 1):
        run_cycle(spark, root, _land_payloads(spark, sf_dir, root, part))
    return read_papers(spark, f"{root}/papers").select(*PAPER_COLUMNS)


@register("stream_load_redropped", with_views(PAPERS_FX_SQL) + """
SELECT url, site_name, keyword, paper_number, title, authors, published_date,
       coalesce(doi, '') AS doi, citation_count, coalesce(journal, '') AS journal
FROM papers_fx""")
def stream_load_redropped(spark, sf_dir):
    """Drop-folder stream (J80) over three starts: half of the papers under a
    log that cannot be written, the other half under the same file names beside
    an empty file, and a start without new files."""
    root = scratch_path(spark, "stream-load")
    p = papers_fx(spark, sf_dir)
    logs = [_blocked_path(spark, f"{root}/blocked"), f"{root}/log", f"{root}/log"]
    for half, log in enumerate(logs):
        if half < 2:
            _land(spark, p.where(F.col("seq") % 2 == half), f"{root}/drops")
        load_stream(spark, f"{root}/drops", f"{root}/papers", log, f"{root}/ckpt", archive_dir=f"{root}/drops/archive")
    return read_papers(spark, f"{root}/papers").select(
        "url", "site_name", "keyword", "paper_number", "title", "authors", "published_date",
        "doi", "citation_count", "journal")
