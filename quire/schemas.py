"""Table contracts of the pipeline (see FIXTURES.md §1)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
TS = T.TimestampNTZType()

# Column order of a paper row everywhere: CSV drops, typed rows,
# stored rows.
PAPER_COLUMNS = [
    "url", "site_name", "keyword", "paper_number", "title", "authors",
    "published_date", "doi", "abstract", "citation_count", "journal",
    "extracted_at",
]

# Normalised paper as written to a CSV drop: text everywhere but the count.
PAPER_RAW = T.StructType(
    [T.StructField(c, I if c == "citation_count" else S, True) for c in PAPER_COLUMNS]
)

# Typed paper as loaded.
PAPER_TYPED = T.StructType([
    T.StructField("url", S), T.StructField("site_name", S),
    T.StructField("keyword", S), T.StructField("paper_number", S),
    T.StructField("title", S), T.StructField("authors", S),
    T.StructField("published_date", T.DateType()), T.StructField("doi", S),
    T.StructField("abstract", S), T.StructField("citation_count", I),
    T.StructField("journal", S), T.StructField("extracted_at", TS),
])

PAPER_STORED = T.StructType(
    [T.StructField("seq", L, False)] + list(PAPER_TYPED.fields)
    + [T.StructField("loaded_at", TS, False)]
)

# Optional columns of a drop; absent from an old header -> NULL.
OPTIONAL_COLUMNS = ["keyword", "doi", "abstract", "citation_count", "journal"]
# Required text columns: absent or empty -> "".
REQUIRED_TEXT_COLUMNS = ["url", "site_name", "paper_number", "title", "authors"]

# Column width caps of the stored paper table, in characters.
WIDTHS = {
    "url": 1000,
    "site_name": 100,
    "keyword": 500,
    "paper_number": 200,
    "title": 2000,
    "doi": 500,
    "journal": 500,
}

LEDGER = T.StructType([
    T.StructField("site_name", S), T.StructField("paper_number", S),
    T.StructField("extracted_at", S),
])

LOAD_LOG = T.StructType([
    T.StructField("log_id", L, False), T.StructField("file_name", S, False),
    T.StructField("total_rows", I, False), T.StructField("loaded_rows", I, False),
    T.StructField("failed_rows", I, False), T.StructField("status", S, False),
    T.StructField("error_msg", S, True), T.StructField("started_at", TS, False),
    T.StructField("finished_at", TS, False),
])

# As stored: with the identity of the file (path, modification time, length).
LOAD_LOG_STORED = T.StructType([*LOAD_LOG.fields, T.StructField("file_id", S)])
# The last number that each load reserved.
SEQ_MARKS = T.StructType([T.StructField("upto", L, False)])
# Load status domain.
SUCCESS, PARTIAL, FAILED = "SUCCESS", "PARTIAL", "FAILED"

TASKS = T.StructType([
    T.StructField("source", S), T.StructField("keyword", S),
    T.StructField("keyword_idx", I), T.StructField("limit", I),
])

# One row per landed response.
PAYLOADS = T.StructType([
    T.StructField("source", S), T.StructField("keyword", S),
    T.StructField("keyword_idx", I), T.StructField("fetched_at", TS),
    T.StructField("status_code", I), T.StructField("body", S),
    T.StructField("file_path", S),
])
