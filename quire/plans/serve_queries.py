"""Registered queries for the serving side (listing, lookup, history, stats)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import query as Q
from quire.plans.catalog import register
from quire.plans.load_queries import _blocked_path, _drop_rows
from quire.plans.load_run import run_load
from quire.schemas import FAILED, PARTIAL, SUCCESS
from quire.session import scratch_path
from quire.sources import segments as G
from quire.sources import serving as V
from quire.sources.serving import write_serving
from quire.sources.sinks import append_papers, write_drop
from quire.sources.tables import read_papers
from quire.plans.fixtures import (LOAD_LOG_FX_SQL, PAPERS_FX_SQL, load_log_fx, papers_fx,
                                  with_views)

P = with_views(PAPERS_FX_SQL)
LG = with_views(LOAD_LOG_FX_SQL)
_LIST = ("seq, url, site_name, keyword, paper_number, title, left(authors, 300) AS authors, "
         "published_date, journal")


@register("paper_listing", P + f"""
SELECT count(*) OVER () AS total_count, {_LIST}
FROM papers_fx
WHERE keyword ILIKE '%kw1%' AND site_name ILIKE '%src1%'
ORDER BY published_date ASC NULLS FIRST, seq ASC
LIMIT 20 OFFSET 5""")
def paper_listing(spark, sf_dir):
    """Filtered, sorted page with the total."""
    return Q.list_papers(papers_fx(spark, sf_dir), skip=5, take=20, keyword=" kw1 ",
                         site="src1", sort="published_date", order="asc")


@register("paper_listing_default", P + f"""
SELECT count(*) OVER () AS total_count, {_LIST}
FROM papers_fx ORDER BY seq DESC LIMIT 20""")
def paper_listing_default(spark, sf_dir):
    """Defaults: no filter, newest seq first, first 20 rows."""
    return Q.list_papers(papers_fx(spark, sf_dir))


@register("paper_listing_title_desc", P + f"""
SELECT count(*) OVER () AS total_count, {_LIST}
FROM papers_fx WHERE site_name ILIKE '%SRC_%'
ORDER BY title DESC NULLS LAST, seq DESC LIMIT 50 OFFSET 40""")
def paper_listing_title_desc(spark, sf_dir):
    """Case-insensitive site match with a live '_' wildcard, title descending."""
    return Q.list_papers(papers_fx(spark, sf_dir), skip=40, take=50, site="SRC_",
                         sort="title", order="DESC")


@register("paper_listing_unknown_sort", P + f"""
SELECT count(*) OVER () AS total_count, {_LIST}
FROM papers_fx WHERE keyword ILIKE '%kw7%'
ORDER BY seq ASC LIMIT 10 OFFSET 3""")
def paper_listing_unknown_sort(spark, sf_dir):
    """A sort column outside the whitelist falls back to seq."""
    return Q.list_papers(papers_fx(spark, sf_dir), skip=3, take=10, keyword="kw7",
                         sort="abstract; drop table", order="asc")


@register("paper_by_seq", P + """
SELECT seq, url, site_name, keyword, paper_number, title, authors, published_date, journal
FROM papers_fx WHERE seq = 42""")
def paper_by_seq(spark, sf_dir):
    """Single paper by seq, full authors."""
    return Q.paper_by_seq(papers_fx(spark, sf_dir), "42")


@register("distinct_sites", P + """
SELECT DISTINCT site_name FROM papers_fx WHERE site_name IS NOT NULL ORDER BY site_name""")
def distinct_sites(spark, sf_dir):
    """Site names for the filter list."""
    return Q.distinct_sites(papers_fx(spark, sf_dir))


@register("latest_papers", P + """
SELECT seq, site_name, title, doi, citation_count FROM papers_fx ORDER BY seq DESC LIMIT 10""")
def latest_papers(spark, sf_dir):
    """Ten newest papers."""
    return Q.latest_papers(papers_fx(spark, sf_dir))


@register("citations_by_site", P + """
SELECT site_name, count(*) AS papers, avg(cast(citation_count AS double)) AS avg_citations
FROM papers_fx WHERE citation_count IS NOT NULL
GROUP BY site_name ORDER BY avg_citations DESC""")
def citations_by_site(spark, sf_dir):
    """Papers and mean citations per site."""
    return Q.citations_by_site(papers_fx(spark, sf_dir))


@register("latest_loads", LG + """
SELECT log_id, file_name, total_rows, loaded_rows, failed_rows, status, error_msg,
       started_at, finished_at
FROM load_log_fx ORDER BY log_id DESC LIMIT 500""")
def latest_loads(spark, sf_dir):
    """History view: newest 500 log rows."""
    return Q.latest_loads(load_log_fx(spark, sf_dir))


@register("latest_loads_brief", LG + """
SELECT log_id, file_name, total_rows, loaded_rows, failed_rows, status, started_at
FROM load_log_fx ORDER BY log_id DESC LIMIT 20""")
def latest_loads_brief(spark, sf_dir):
    """Check query: newest 20 log rows, 7 columns."""
    return Q.latest_loads(load_log_fx(spark, sf_dir), Q.BRIEF_LOG_ROWS, Q.LOG_BRIEF_COLUMNS)


_STATS_SQL = """
SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'FAILED' AND status <> 'RUNNING') AS success,
       count(*) FILTER (WHERE status = 'FAILED') AS failed,
       cast(ifnull(sum(loaded_rows), 0) AS bigint) AS loaded_rows
FROM load_log_fx"""


@register("load_stats", LG + _STATS_SQL)
def load_stats(spark, sf_dir):
    """Run statistics over the whole log."""
    return Q.load_stats(load_log_fx(spark, sf_dir))


def _stats_by(*statuses: str) -> str:
    parts = [f"SELECT '{x}' AS status, s.* FROM ({_STATS_SQL} WHERE status = '{x}') s" for x in statuses]
    return LG + " UNION ALL ".join(parts)


def _stats_of(log, *statuses: str):
    """The statistics of each status, all from one pass over the whole log."""
    by = log.groupBy("status").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("loaded_rows").cast("bigint")).alias("loaded_rows"))
    known = log.sparkSession.createDataFrame([(s, s in (SUCCESS, PARTIAL), s == FAILED) for s in statuses],
                                             "status string, good boolean, bad boolean")
    n, zero = F.coalesce("total", F.lit(0)), F.lit(0).cast("bigint")
    return known.join(by, "status", "left").select(
        "status", n.alias("total"), F.when(F.col("good"), n).otherwise(zero).alias("success"),
        F.when(F.col("bad"), n).otherwise(zero).alias("failed"), F.coalesce("loaded_rows", zero).alias("loaded_rows"))


@register("load_stats_failed_only", _stats_by("FAILED", "SUCCESS", "PARTIAL"))
def load_stats_failed_only(spark, sf_dir):
    """Statistics of the FAILED runs (no loaded rows) beside those of the others."""
    return _stats_of(load_log_fx(spark, sf_dir), FAILED, SUCCESS, PARTIAL)


@register("load_stats_empty", _stats_by("SUCCESS", "PARTIAL", "FAILED", "RUNNING"))
def load_stats_empty(spark, sf_dir):
    """Statistics of every status over the whole log, zeros for one without runs."""
    return _stats_of(load_log_fx(spark, sf_dir), SUCCESS, PARTIAL, FAILED, "RUNNING")


@register("load_duration", LG + """
SELECT log_id, status,
       date_diff('microsecond', started_at, finished_at) / 1e6 AS duration_sec,
       CASE WHEN date_diff('microsecond', started_at, finished_at) / 1e6 < 60
              THEN printf('%.1f', round(date_diff('microsecond', started_at, finished_at) / 1e6, 1)) || '초'
            WHEN date_diff('microsecond', started_at, finished_at) / 1e6 / 60 < 60
              THEN cast(floor(date_diff('microsecond', started_at, finished_at) / 1e6 / 60) AS bigint) || '분 '
                   || cast(cast(floor(date_diff('microsecond', started_at, finished_at) / 1e6) AS bigint) % 60 AS varchar) || '초'
            ELSE printf('%.1f', round(date_diff('microsecond', started_at, finished_at) / 1e6 / 3600, 1)) || '시간'
       END AS duration_text
FROM load_log_fx""")
def load_duration(spark, sf_dir):
    """Per-run duration in seconds and as display text."""
    return Q.with_duration(load_log_fx(spark, sf_dir)).select(
        "log_id", "status", "duration_sec", "duration_text")


def _by_key(spark, sf_dir, order):
    """The second page of a listing, found from the last row of the first."""
    papers = papers_fx(spark, sf_dir)
    last = Q.list_papers(papers, take=30, sort="journal", order=order).collect()[-1]
    return Q.list_papers(papers, take=30, sort="journal", order=order, after=(last["journal"], last["seq"]))


@register("paper_listing_by_key", P + f"""
SELECT (SELECT count(*) FROM papers_fx) AS total_count, {_LIST}
FROM papers_fx ORDER BY journal ASC NULLS FIRST, seq ASC LIMIT 30 OFFSET 30""")
def paper_listing_by_key(spark, sf_dir):
    """Keyset page through the rows without a sort value."""
    return _by_key(spark, sf_dir, "asc")


@register("paper_listing_by_key_desc", P + f"""
SELECT (SELECT count(*) FROM papers_fx) AS total_count, {_LIST}
FROM papers_fx ORDER BY journal DESC NULLS LAST, seq DESC LIMIT 30 OFFSET 30""")
def paper_listing_by_key_desc(spark, sf_dir):
    """Keyset page in descending order."""
    return _by_key(spark, sf_dir, "desc")


@register("paper_listing_past_end", P + f"""
SELECT (SELECT count(*) FROM papers_fx) AS total_count, {_LIST} FROM (
  SELECT *, row_number() OVER (ORDER BY journal ASC NULLS FIRST, seq ASC) AS rn FROM papers_fx)
WHERE rn > (SELECT count(*) FROM papers_fx) - 7""")
def paper_listing_past_end(spark, sf_dir):
    """A page that runs past the last row of the whole table: the rows there are."""
    papers = papers_fx(spark, sf_dir)
    return Q.list_papers(papers, skip=papers.count() - 7, take=20, sort="journal", order="asc")


def served_papers(spark, sf_dir, files: int = 20) -> str:
    """A paper table of some files with its serving tables: one file is stored
    first with other rows, then replaced."""
    path = f"{scratch_path(spark, 'served')}/papers"
    rows = papers_fx(spark, sf_dir).withColumns({
        "file_id": F.format_string("f%02d", F.pmod(F.col("seq"), F.lit(files))),
        "extracted_at": F.lit(None).cast("timestamp_ntz"), "loaded_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    wrong = rows.withColumns({"keyword": F.lit("wrong"), "site_name": F.lit("wrong"), "citation_count": F.lit(1)})
    append_papers(wrong.where("file_id = 'f03'").unionByName(rows.where("file_id <> 'f03'")), path)
    write_serving(spark, path)
    append_papers(rows.where("file_id = 'f03'"), path)
    write_serving(spark, path, ["f03"])
    return path


@register("paper_listing_by_pieces", P + f"""
SELECT count(*) OVER () AS total_count, {_LIST}
FROM papers_fx
WHERE keyword ILIKE '%kw1%' AND site_name ILIKE '%src1%'
ORDER BY published_date ASC NULLS FIRST, seq ASC
LIMIT 20 OFFSET 5""")
def paper_listing_by_pieces(spark, sf_dir):
    """The filtered listing (J60a) through the table of three-letter pieces."""
    return V.list_by_pieces(spark, served_papers(spark, sf_dir), " kw1 ", "src1", skip=5, take=20,
                            sort="published_date", order="asc").drop("extracted_at", "loaded_at")


@register("paper_listing_by_pieces_wild", P + f"""
SELECT count(*) OVER () AS total_count, {_LIST}
FROM papers_fx WHERE keyword ILIKE '%w1%' AND site_name ILIKE '%SR_1%7%'
ORDER BY title DESC NULLS LAST, seq DESC LIMIT 50""")
def paper_listing_by_pieces_wild(spark, sf_dir):
    """Wildcards in the patterns, whose runs are too short for pieces."""
    return V.list_by_pieces(spark, served_papers(spark, sf_dir), "w1", "SR_1%7", take=50, sort="title",
                            order="DESC").drop("extracted_at", "loaded_at")


def _deep(sort: str, order: str) -> str:
    by = f"{sort} {'ASC NULLS FIRST' if order == 'asc' else 'DESC NULLS LAST'}, seq {order}"
    return P + f"""SELECT (SELECT count(*) FROM papers_fx) AS total_count, {_LIST} FROM (
  SELECT *, row_number() OVER (ORDER BY {by}) AS rn FROM papers_fx)
WHERE rn > (SELECT count(*) FROM papers_fx) * 2 // 3 AND rn <= (SELECT count(*) FROM papers_fx) * 2 // 3 + 40"""


def _deep_page(spark, sf_dir, sort: str, order: str):
    path = served_papers(spark, sf_dir)
    V.write_order(spark, path, sort, range_rows=64)
    skip = papers_fx(spark, sf_dir).count() * 2 // 3
    return V.page_by_order(spark, path, sort, order, skip, 40).drop("extracted_at", "loaded_at")


@register("paper_page_by_order", _deep("journal", "asc"))
def paper_page_by_order(spark, sf_dir):
    """A page far behind (J60): ties and NULLs of the sort column, ranges of 64 rows."""
    return _deep_page(spark, sf_dir, "journal", "asc")


@register("paper_page_by_order_desc", _deep("published_date", "desc"))
def paper_page_by_order_desc(spark, sf_dir):
    """The same in descending order, where NULLs come last."""
    return _deep_page(spark, sf_dir, "published_date", "desc")


@register("sites_from_sums", P + """
SELECT DISTINCT site_name FROM papers_fx WHERE site_name IS NOT NULL ORDER BY site_name""")
def sites_from_sums(spark, sf_dir):
    """Site names (J62) from the sums of the files, one of them replaced."""
    return V.sites_from_sums(spark, served_papers(spark, sf_dir))


@register("citations_from_sums", P + """
SELECT site_name, count(*) AS papers, avg(cast(citation_count AS double)) AS avg_citations
FROM papers_fx WHERE citation_count IS NOT NULL
GROUP BY site_name ORDER BY avg_citations DESC""")
def citations_from_sums(spark, sf_dir):
    """Papers and mean citations per site (J70) merged from the sums of files
    that a load cycle wrote, with a log that fails in the first cycle."""
    root = scratch_path(spark, "served")
    p = papers_fx(spark, sf_dir)
    write_drop(_drop_rows(p.where("seq % 2 = 0")), f"{root}/drops", "b0")
    run_load(spark, f"{root}/drops", f"{root}/papers", _blocked_path(spark, f"{root}/blocked"), serving=True)
    write_drop(_drop_rows(p.where("seq % 2 = 1")), f"{root}/drops", "b1")
    for _ in range(2):  # the first files are in no log and load again
        run_load(spark, f"{root}/drops", f"{root}/papers", f"{root}/log", serving=True)
    return V.citations_from_sums(spark, f"{root}/papers")


def compacted_papers(spark, sf_dir, crash: bool = False) -> str:
    """The served paper table compacted, one old file loaded again with other
    rows and compacted, and once more with its own rows; with ``crash`` the last
    compaction ends before it removes what it took in."""
    path = served_papers(spark, sf_dir)
    G.compact_papers(spark, path, segment_rows=64)
    own = G.read_stored(spark, path).where("file_id = 'f07'").checkpoint(eager=True)
    append_papers(own.withColumn("title", F.lit("other")), path)
    G.compact_papers(spark, path, segment_rows=64)
    append_papers(own, path)
    if crash:
        G.compact_papers(spark, path, segment_rows=64, clean=False)
    return path


@register("papers_compacted", P + """
SELECT seq, url, site_name, keyword, paper_number, title, authors, published_date, doi, abstract, citation_count, journal FROM papers_fx""")
def papers_compacted(spark, sf_dir):
    """The whole stored table (J05, J08) after compactions, a file loaded again
    after them, and a crash between the steps."""
    return read_papers(spark, compacted_papers(spark, sf_dir, crash=True)).drop("extracted_at", "loaded_at")


@register("paper_by_seq_compacted", P + """
SELECT seq, url, site_name, keyword, paper_number, title, authors, published_date, journal
FROM papers_fx WHERE seq = 42""")
def paper_by_seq_compacted(spark, sf_dir):
    """A paper (J63) from the segment whose range holds it."""
    return G.stored_paper_by_seq(spark, compacted_papers(spark, sf_dir), 42).drop("extracted_at", "loaded_at")
