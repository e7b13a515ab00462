"""String and nested-value expressions used by the normalisers and loader."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes (str.isspace),
# written as a regex class that Java regex and RE2 both accept.
WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_EDGE_WS = rf"\A{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+\z"
# Fixed value: markup tag pattern.
TAG_PATTERN = r"<[^>]+>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """NULL -> '' (a missing text field becomes an empty CSV cell)."""
    return F.coalesce(_c(c), F.lit(""))


def blank_to_null(c) -> Column:
    return F.when(F.length(_c(c)) > 0, _c(c))


def py_strip(c) -> Column:
    """Remove leading/trailing whitespace as Python's str.strip() does.

    Spark's trim() only removes spaces, so a regex over the full class is used.
    """
    return F.regexp_replace(_c(c), _EDGE_WS, "")


def strip_markup(c) -> Column:
    """Drop every <...> tag, then strip surrounding whitespace."""
    return py_strip(F.regexp_replace(nz(c), TAG_PATTERN, ""))


def last_segment(c, sep: str) -> Column:
    """Text after the last occurrence of ``sep`` (whole text when absent)."""
    return F.element_at(F.split(nz(c), re.escape(sep)), -1)


def remove_all(c, s: str) -> Column:
    return F.replace(nz(c), F.lit(s), F.lit(""))


def left_chars(c, n: int) -> Column:
    """First ``n`` characters (code points), NULL stays NULL."""
    return F.substring(_c(c), 1, n)


def first_nonempty(*cols) -> Column:
    """First argument that is neither NULL nor '' (else '')."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def join_names(arr, field: str | None = None, sep: str = ", ") -> Column:
    """Join the names of a person list; NULL names stay as empty items."""
    if field is None:
        items = F.transform(_c(arr), lambda a: F.coalesce(a, F.lit("")))
    else:
        items = F.transform(_c(arr), lambda a: F.coalesce(a[field], F.lit("")))
    return F.concat_ws(sep, F.coalesce(items, F.array().cast("array<string>")))


def first_doi(arr) -> Column:
    """First list element starting with '10.' ('' when none)."""
    hits = F.filter(_c(arr), lambda x: x.startswith("10."))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))


def _is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def variant_text(v) -> Column:
    """A scalar variant as text; NULL for SQL NULL or JSON null."""
    v = _c(v)
    return F.when(~F.is_variant_null(v), F.try_variant_get(v, "$", "string"))


def variant_first_text(v) -> Column:
    """String-or-list field: the first element of a list, else the value."""
    v = _c(v)
    return F.when(
        _is_array(v), F.try_variant_get(v, "$[0]", "string")
    ).otherwise(variant_text(v))


def variant_texts(v) -> Column:
    """String-or-list field as array<string> (a scalar becomes one item)."""
    v = _c(v)
    return F.when(_is_array(v), F.try_variant_get(v, "$", "array<string>")).when(
        v.isNotNull() & ~F.is_variant_null(v), F.array(variant_text(v))
    )
