"""Abstract text from a word -> positions inverted index (one row at a time)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text_from_inverted_index(m) -> Column:
    """Words ordered by their smallest position, joined by one space.

    A word that occurs several times appears once, at its first position.
    NULL or empty index -> ''.
    """
    m = F.col(m) if isinstance(m, str) else m
    first = F.transform(F.map_values(m), lambda v: F.array_min(v))
    # sort_array's natural ordering is cheaper than array_sort's comparator
    ordered = F.sort_array(F.arrays_zip(first.alias("p"), F.map_keys(m).alias("w")))
    return F.coalesce(F.array_join(ordered["w"], " "), F.lit(""))
