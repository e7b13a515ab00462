"""Cleaning and typing of loaded drops (J40-J46), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.dates import parse_int, parse_pub_date, parse_timestamp
from quire.schemas import PAPER_COLUMNS, PARTIAL, REQUIRED_TEXT_COLUMNS, SUCCESS, WIDTHS


def _present(name: str, present_col: str) -> Column:
    return F.array_contains(F.col(present_col), F.lit(name))


def conform(df: DataFrame, present_col: str = "present") -> DataFrame:
    """Back-fill by header (J40) and empty-versus-NULL.

    Required text columns are never NULL (''); an optional column the file's
    header lacks is NULL; a column the header has keeps an empty field as ''.
    """
    out = []
    for c in PAPER_COLUMNS:
        if c in REQUIRED_TEXT_COLUMNS:
            e = F.coalesce(F.col(c), F.lit(""))
        elif c in ("published_date", "citation_count", "extracted_at"):
            e = F.col(c)  # typed later; empty and missing both become NULL
        else:  # optional text
            e = F.when(_present(c, present_col), F.coalesce(F.col(c), F.lit("")))
        out.append(e.alias(c))
    keep = [c for c in df.columns if c not in PAPER_COLUMNS]
    return df.select(*keep, *out)


def type_columns(df: DataFrame) -> DataFrame:
    """Text -> DATE / INT / TIMESTAMP_NTZ (J41, J42); bad text -> NULL."""
    return (df.withColumn("published_date", parse_pub_date(F.col("published_date")))
            .withColumn("citation_count", parse_int(F.col("citation_count")))
            .withColumn("extracted_at", parse_timestamp(F.col("extracted_at"))))


def cap_widths(df: DataFrame, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """Cut over-long text to the stored width (J44), counted in characters."""
    return df.select(*[F.left(F.col(c), F.lit(widths[c])).alias(c) if c in widths else F.col(c)
                       for c in df.columns])


def truncation_counts(df: DataFrame, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """How many values each width cap cuts (one row)."""
    return df.agg(*[F.count_if(F.length(c) > n).alias(f"cut_{c}") for c, n in widths.items()
                    if c in df.columns])


def split_bad_rows(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) by a row condition (J45f); NULL counts as good."""
    flag = F.coalesce(bad, F.lit(False))
    return df.filter(~flag), df.filter(flag)


def load_results(rows: DataFrame) -> DataFrame:
    """Per-file load result (J45) of scanned rows, header rows included:
    total = loaded + failed, SUCCESS when no row failed else PARTIAL, and when
    the file was first and last read. ``good_no`` is NULL for rejected rows."""
    data = F.col("row_no") > 0
    res = rows.groupBy("file_name").agg(
        F.count_if(data).cast("int").alias("total_rows"),
        F.count("good_no").cast("int").alias("loaded_rows"),
        F.min("seen_at").alias("started_at"),
        F.max("seen_at").alias("finished_at"))
    failed = F.col("total_rows") - F.col("loaded_rows")
    return res.select("file_name", "total_rows", "loaded_rows", failed.alias("failed_rows"),
                      F.when(failed == 0, F.lit(SUCCESS)).otherwise(F.lit(PARTIAL)).alias("status"),
                      F.lit(None).cast("string").alias("error_msg"), "started_at", "finished_at")


def unparsed_dates_by_site(raw: DataFrame, date_col: str = "published_date",
                           site_col: str = "site_name") -> DataFrame:
    """Per site: rows with date text, and how many of them no rule could
    type (J41 report). ``raw`` holds the date as text."""
    from quire.functions.dates import parse_pub_date
    from quire.functions.text import py_strip
    has_text = F.length(py_strip(F.coalesce(F.col(date_col), F.lit("")))) > 0
    typed = parse_pub_date(F.col(date_col))
    return raw.groupBy(site_col).agg(
        F.count_if(has_text).alias("dated_rows"),
        F.count_if(has_text & typed.isNull()).alias("unparsed_dates"))
