"""Typing of text fields at load time: dates, timestamps, integers.

Every parser is a closed list of patterns guarded by a shape test, so a value
either matches one rule exactly or becomes NULL; nothing depends on the
machine's locale or clock.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.text import py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _date(raw: Column, fmt: str) -> Column:
    return F.try_to_date(raw, fmt)


def parse_pub_date(c) -> Column:
    """Publication date text -> DATE.

    1. strict ``yyyy-MM-dd``;
    2. seven characters ``yyyy-MM`` -> first of the month;
    3. four digits with 1900 <= year <= 2100 -> 1 January;
    4. general fallback, closed list: ``yyyy-M-d``, ``yyyy-M``, ``yyyy/M/d``,
       ``M/d/yyyy`` (month first, as the invariant culture reads it),
       ``d MMMM yyyy``, ``MMMM yyyy``, ``MMMM d, yyyy`` (full or three-letter
       month names) and ISO timestamps (date as written);
    5. anything else (blank, ``None``, other years) -> NULL.
    """
    raw = py_strip(_c(c))
    year4 = F.when(raw.rlike(r"^[0-9]{4}$"), raw.cast("int"))
    return (
        F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
               & _date(raw, "yyyy-MM-dd").isNotNull(), _date(raw, "yyyy-MM-dd"))
        .when((F.length(raw) == 7) & raw.rlike(r"^[0-9]{4}-[0-9]{2}$"),
              _date(raw, "yyyy-MM"))
        .when((F.length(raw) == 4) & year4.between(1900, 2100),
              F.make_date(year4, F.lit(1), F.lit(1)))
        .when(raw.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), _date(raw, "yyyy-M-d"))
        .when(raw.rlike(r"^[0-9]{4}-[0-9]{1,2}$"), _date(raw, "yyyy-M"))
        .when(raw.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), _date(raw, "yyyy/M/d"))
        .when(raw.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), _date(raw, "M/d/yyyy"))
        .when(raw.rlike(r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$"),
              F.coalesce(_date(raw, "d MMMM yyyy"), _date(raw, "d MMM yyyy")))
        .when(raw.rlike(r"^[A-Za-z]+ [0-9]{4}$"),
              F.coalesce(_date(raw, "MMMM yyyy"), _date(raw, "MMM yyyy")))
        .when(raw.rlike(r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$"),
              F.coalesce(_date(raw, "MMMM d, yyyy"), _date(raw, "MMM d, yyyy")))
        .when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"),
              _date(F.substring(raw, 1, 10), "yyyy-MM-dd"))
    )


# Accepted timestamp layouts for ``extracted_at``.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
]


EXACT_TIMESTAMP = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"
                   r"(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})?$")


def parse_timestamp(c) -> Column:
    """Timestamp text -> TIMESTAMP_NTZ (wall clock), bad text -> NULL. Text
    with a fraction of a second keeps it; text with ``Z`` or an offset is the
    wall clock of the session's time zone."""
    raw = py_strip(_c(c))
    tries = [F.try_to_timestamp(raw, F.lit(f)) for f in TIMESTAMP_FORMATS]
    exact = F.when(raw.rlike(EXACT_TIMESTAMP), raw.try_cast("timestamp_ltz").cast("timestamp_ntz"))
    return F.coalesce(*[t.cast("timestamp_ntz") for t in tries], exact)


def parse_int(c) -> Column:
    """Signed decimal integer text -> INT; other text or overflow -> NULL."""
    raw = py_strip(_c(c))
    return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("int"))
