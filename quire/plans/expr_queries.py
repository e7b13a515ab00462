"""Registered queries for the column expressions the normalisers use,
each over a whole test table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.inverted import text_from_inverted_index
from quire.functions.text import WHITESPACE_CLASS, join_names, last_segment, strip_markup
from quire.plans.catalog import register
from quire.plans.fixtures import table
from quire.plans.payload_fixtures import _inverted_index

WS = WHITESPACE_CLASS


@register("strip_markup", rf"""
SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'),
                               '\A{WS}+|{WS}+\z', '', 'g') AS text
FROM pages""")
def strip_markup_query(spark, sf_dir):
    """Tags removed and outer whitespace stripped (E2) on raw web pages."""
    return table(spark, sf_dir, "pages").select("page_id", strip_markup(F.col("html")).alias("text"))


@register("inverted_abstract", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
                  generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
     m AS (SELECT doc_id, word, min(pos) AS p FROM w GROUP BY doc_id, word)
SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS abstract FROM m GROUP BY doc_id""")
def inverted_abstract(spark, sf_dir):
    """Abstract text rebuilt from a word -> positions index (E1); the index
    of every document's text is the input."""
    idx = _inverted_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return idx.select("doc_id", text_from_inverted_index(F.col("inv")).alias("abstract"))


@register("join_names", """
SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS authors,
       string_agg(role, ' and ' ORDER BY turn) AS authors_and
FROM conversations GROUP BY conv_id""")
def join_names_query(spark, sf_dir):
    """Person lists joined with ', ' and ' and ' (E7); each conversation's
    speakers in turn order stand in for a paper's author list."""
    conv = table(spark, sf_dir, "conversations")
    people = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    arr = F.transform("t", lambda x: F.struct(x["role"].alias("name")))
    return people.select("conv_id", join_names(arr, "name").alias("authors"),
                         join_names(F.transform("t", lambda x: x["role"]), sep=" and ").alias("authors_and"))


@register("last_segment", """
SELECT page_id, string_split(url, '/')[-1] AS tail,
       string_split(url, '.example.')[-1] AS after_marker FROM pages""")
def last_segment_query(spark, sf_dir):
    """Text after the last '/' and after the last marker."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", last_segment(F.col("url"), "/").alias("tail"),
                    last_segment(F.col("url"), ".example.").alias("after_marker"))
