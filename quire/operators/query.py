"""Questions asked of the paper table and the load log.

All are lazy DataFrames. Paging uses TakeOrderedAndProject (each partition
keeps only skip+take rows); totals are a partial/final aggregate evaluated
once as a scalar subquery, never a window over all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.duration import duration_seconds, duration_text
from quire.schemas import FAILED, PARTIAL, SUCCESS

# Columns of a listing row and of a single-paper lookup.
LISTING_COLUMNS = [
    "seq", "url", "site_name", "keyword", "paper_number", "title", "authors",
    "published_date", "journal", "extracted_at", "loaded_at",
]
# Sortable columns; anything else sorts by seq.
SORTABLE = ["loaded_at", "published_date", "title", "site_name", "journal", "seq"]
# Listing defaults and the authors cut.
DEFAULT_SKIP, DEFAULT_TAKE, AUTHORS_CUT = 0, 20, 300
# Load-log columns (full history view and the brief check query).
LOG_COLUMNS = [
    "log_id", "file_name", "total_rows", "loaded_rows", "failed_rows",
    "status", "error_msg", "started_at", "finished_at",
]
LOG_BRIEF_COLUMNS = [
    "log_id", "file_name", "total_rows", "loaded_rows", "failed_rows",
    "status", "started_at",
]
# History size shown and the size of the brief check queries.
HISTORY_ROWS, BRIEF_LOG_ROWS, LATEST_PAPERS = 500, 20, 10
LATEST_PAPER_COLUMNS = ["seq", "site_name", "title", "doi", "citation_count", "loaded_at"]


def _present(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def _like_pattern(text: str) -> str:
    # '%' and '_' typed by the user stay wildcards; a backslash stays literal.
    return "%" + text.replace("\\", "\\\\") + "%"


def filter_papers(papers: DataFrame, keyword: str | None = None,
                  site: str | None = None) -> DataFrame:
    """``keyword`` / ``site_name`` substring match, each only when non-blank."""
    kw, st = (keyword or "").strip(), (site or "").strip()
    df = papers
    if kw:
        df = df.filter(F.col("keyword").ilike(_like_pattern(kw)))
    if st:
        df = df.filter(F.col("site_name").ilike(_like_pattern(st)))
    return df


def list_papers(papers: DataFrame, skip: int = DEFAULT_SKIP, take: int = DEFAULT_TAKE,
                keyword: str | None = None, site: str | None = None,
                sort: str | None = None, order: str | None = None,
                columns: list[str] | None = None, after: tuple | None = None,
                total: Column | None = None) -> DataFrame:
    """One page of papers plus ``total_count`` of all matching rows.

    Sort column from the whitelist (else ``seq``), ascending only for exactly
    ``"asc"``; ``seq`` in the same direction breaks ties so pages are stable.
    NULLs sort lowest. ``authors`` is cut to 300 characters.

    ``after`` pages by key instead of by offset: the (sort value, seq) of the
    last row of the page before. A deep page then costs what the first one
    does, where OFFSET makes every task keep and merge all rows before it.
    ``total`` stands for the count of matching rows if the caller knows it.
    """
    skip, take = max(int(skip), 0), max(int(take), 0)
    df = filter_papers(papers, keyword, site)
    sort_col = sort if sort in SORTABLE and sort in df.columns else "seq"
    asc = order == "asc"
    keys = [F.col(sort_col).asc_nulls_first() if asc else F.col(sort_col).desc_nulls_last()]
    if sort_col != "seq":
        keys.append(F.col("seq").asc() if asc else F.col("seq").desc())
    cols = _present(df, columns or LISTING_COLUMNS)
    proj = [F.left(F.col(c), F.lit(AUTHORS_CUT)).alias(c) if c == "authors" else F.col(c)
            for c in cols]
    # sort keys may be outside the projection; Catalyst prunes the rest
    rest = df if after is None else df.where(_behind(sort_col, asc, *after))
    page = rest.orderBy(*keys).select(*proj).offset(skip).limit(take)
    # the total is an uncorrelated scalar subquery: one partial/final count,
    # evaluated once, no join and no window over the rows
    total = df.agg(F.count(F.lit(1))).scalar() if total is None else total
    return page.select(total.alias("total_count"), *cols)


def _behind(sort_col: str, asc: bool, value, seq: int):
    """Rows behind (value, seq) in the listing's order; NULLs sort lowest."""
    c, v = F.col(sort_col), F.lit(value)
    later = F.col("seq") > seq if asc else F.col("seq") < seq
    if sort_col == "seq":
        return later
    if value is None:
        return (c.isNull() & later) | c.isNotNull() if asc else c.isNull() & later
    beyond = c > v if asc else (c < v) | c.isNull()
    return F.coalesce(beyond, F.lit(False)) | F.coalesce((c == v) & later, F.lit(False))


def fetch_page(papers: DataFrame, **kw) -> dict:
    """``{"data": [...], "totalCount": n}``; an empty page reports 0."""
    rows = [r.asDict() for r in list_papers(papers, **kw).collect()]
    total = rows[0]["total_count"] if rows else 0
    for r in rows:
        r.pop("total_count")
    return {"data": rows, "totalCount": total}


def parse_seq(text) -> int:
    """Leading signed integer of the text; no digits -> ValueError."""
    if isinstance(text, int):
        return text
    m = re.match(r"^\s*([+-]?\d+)", str(text))
    if not m:
        raise ValueError(f"seq must be a number: {text!r}")
    return int(m.group(1))


def paper_by_seq(papers: DataFrame, seq) -> DataFrame:
    """Point lookup; full authors. Pushed to Parquet min/max statistics."""
    value = parse_seq(seq)
    return papers.filter(F.col("seq") == F.lit(value)).select(*_present(papers, LISTING_COLUMNS))


def get_paper(papers: DataFrame, seq) -> dict:
    rows = paper_by_seq(papers, seq).limit(1).collect()
    if not rows:
        raise LookupError(f"paper not found: {seq}")
    return rows[0].asDict()


def distinct_sites(papers: DataFrame) -> DataFrame:
    """Distinct non-NULL site names, ascending (partial aggregation first)."""
    return (papers.select("site_name").where(F.col("site_name").isNotNull())
            .distinct().orderBy("site_name"))


def latest_papers(papers: DataFrame, n: int = LATEST_PAPERS) -> DataFrame:
    return papers.orderBy(F.col("seq").desc()).select(
        *_present(papers, LATEST_PAPER_COLUMNS)).limit(n)


def citations_by_site(papers: DataFrame) -> DataFrame:
    """Papers with a citation count and their average, per site, by average desc."""
    return (papers.where(F.col("citation_count").isNotNull())
            .groupBy("site_name")
            .agg(F.count(F.lit(1)).alias("papers"),
                 F.avg(F.col("citation_count").cast("double")).alias("avg_citations"))
            .orderBy(F.col("avg_citations").desc(), F.col("site_name")))


def latest_loads(log: DataFrame, n: int = HISTORY_ROWS,
                 columns: list[str] | None = None) -> DataFrame:
    """Newest ``n`` load-log rows by ``log_id`` descending."""
    return log.orderBy(F.col("log_id").desc()).select(*(columns or LOG_COLUMNS)).limit(n)


def load_stats(log: DataFrame) -> DataFrame:
    """Runs, successful (SUCCESS or PARTIAL), failed, rows loaded; zeros when empty."""
    zero = F.lit(0).cast("long")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("status").isin(SUCCESS, PARTIAL), 1).otherwise(0)),
                   zero).alias("success"),
        F.coalesce(F.sum(F.when(F.col("status") == FAILED, 1).otherwise(0)), zero).alias("failed"),
        F.coalesce(F.sum(F.col("loaded_rows").cast("long")), zero).alias("loaded_rows"),
    )


def with_duration(log: DataFrame) -> DataFrame:
    """Adds ``duration_sec`` and the display text ``duration_text``."""
    secs = duration_seconds("started_at", "finished_at")
    return log.withColumn("duration_sec", secs).withColumn(
        "duration_text", duration_text(F.col("duration_sec")))
