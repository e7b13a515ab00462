"""Column expressions shared by the jobs (all JVM-side, no Python UDFs)."""

from quire.functions.text import (  # noqa: F401
    blank_to_null, first_doi, first_nonempty, join_names, last_segment,
    left_chars, nz, py_strip, remove_all, strip_markup, variant_first_text,
    variant_text, WHITESPACE_CLASS,
)
from quire.functions.dates import parse_pub_date, parse_int, parse_timestamp  # noqa: F401
from quire.functions.inverted import text_from_inverted_index  # noqa: F401
from quire.functions.duration import duration_seconds, duration_text  # noqa: F401
