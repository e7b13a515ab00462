"""Stand-in source responses built from the ``documents`` table.

Every document becomes one record in the response shape of a source; records
are grouped 20 to a response (one harvest task). Values follow FIXTURES.md
(paper number repeats the document 20 before it for every third document).
This module only shapes input: parsing and normalising are the jobs under
test, in ``quire.sources.normalisers``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quire.plans.fixtures import table
from quire.session import scratch_path
from quire.sources.payloads import land_payloads, read_payloads

RECORDS_PER_RESPONSE = 20
BASE_TS = "2024-01-01 00:00:00"
ATOM_ROOT = ('<feed xmlns="http://www.w3.org/2005/Atom" '
             'xmlns:arxiv="http://arxiv.org/schemas/atom">')


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document columns shaped as raw paper values (NULL = field missing)."""
    doc = F.col("doc_id")
    chunk = F.floor(doc / float(RECORDS_PER_RESPONSE)).cast("long")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source",
        (doc - F.when((doc % 3 == 0) & (doc >= 20), 20).otherwise(0)).alias("num"),
        F.left("text", F.lit(60)).alias("title_raw"),
        F.array(F.concat("lang", F.lit(" One")), F.concat("source", F.lit(" Two"))).alias("names"),
        F.when(doc % 7 != 0, F.concat(F.lit("20"), F.lpad(_s(doc % 25), 2, "0"), F.lit("-0"),
                                      _s(1 + doc % 9), F.lit("-15"))).alias("date_raw"),
        F.when(doc % 4 != 0, F.concat(F.lit("10.1000/"), _s(doc))).alias("doi_raw"),
        # counts come as numbers, as text, or longer than an integer
        F.when(doc % 5 != 0, F.parse_json(
            F.when(doc % 11 == 1, F.concat(F.lit('"'), _s(F.col("n_chars") % 100), F.lit('"')))
            .when(doc % 11 == 2, F.lit("3000000000")).otherwise(_s(F.col("n_chars") % 100)))).alias("cites"),
        F.when(doc % 6 != 0, F.concat(F.lit("J"), _s(doc % 10))).alias("journal_raw"),
        chunk.alias("chunk"),
    )


def _year(c: Column) -> Column:
    return F.substring(c, 1, 4).cast("int")


def _rec_arxiv(d):
    rid = F.when(F.col("doc_id") % 50 != 0,
                 F.concat(F.lit("http://arxiv.org/abs/"), _s("num"), F.lit("v"), _s(1 + F.col("doc_id") % 3)))
    return F.struct(
        rid.alias("id"), F.col("title_raw").alias("title"),
        F.transform("names", lambda n: F.struct(n.alias("name"))).alias("author"),
        F.concat("date_raw", F.lit("T08:00:00Z")).alias("published"),
        F.col("text").alias("summary"), F.col("doi_raw").alias("arxiv_doi"),
        F.col("journal_raw").alias("arxiv_journal_ref"))


def _rec_semantic_scholar(d):
    ext = F.when(F.col("doi_raw").isNotNull(), F.struct(F.col("doi_raw").alias("DOI")))
    even = F.col("doc_id") % 2 == 0
    return F.struct(
        F.concat(F.lit("ss"), _s("num")).alias("paperId"),
        F.concat(F.lit("https://www.semanticscholar.org/paper/"), _s("num")).alias("url"),
        F.col("title_raw").alias("title"),
        F.transform("names", lambda n: F.struct(n.alias("name"))).alias("authors"),
        _year(F.col("date_raw")).alias("year"), ext.alias("externalIds"),
        F.col("text").alias("abstract"), F.col("cites").alias("citationCount"),
        F.when(even, F.struct(F.col("journal_raw").alias("name"))).alias("publicationVenue"),
        F.struct(F.concat(F.lit("Alt "), F.coalesce("journal_raw", F.lit("none"))).alias("name"))
        .alias("journal"))


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def _positions(texts: pa.Array) -> pa.Array:
    split = pc.split_pattern(texts, " ")
    size = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    words = pc.list_flatten(split).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary)  # by UTF-8 bytes, as Spark sorts
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    owner = np.repeat(np.arange(len(size)), size)
    key = owner * max(len(order), 1) + rank[words.indices.to_numpy()]
    at = np.argsort(key, kind="stable")  # by text, word and position
    new = np.ones(len(at), bool)
    new[1:] = key[at][1:] != key[at][:-1]
    first = np.flatnonzero(new)
    ends = np.append(first, len(at)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((at - begin[owner[at]]).astype(np.int32)))
    keys = words.dictionary.take(words.indices.take(pa.array(at[first])))
    starts = np.searchsorted(owner[at[first]], np.arange(len(size) + 1)).astype(np.int32)
    none = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
    return pa.MapArray.from_arrays(pa.array(starts, mask=none), keys, lists)


def with_inverted_index(df: DataFrame, text: str = "text", out: str = "inv",
                        when: Column | None = None) -> DataFrame:
    """Adds map(word -> ascending positions) of ``text`` split on single
    spaces, words in order, built inside the row: no shuffle. Only the texts
    that meet ``when`` go through Python."""
    given = F.col(text) if when is None else F.when(when, F.col(text))
    return df.withColumn(out, _positions(given))


def _inverted_index(docs: DataFrame) -> DataFrame:
    """doc_id -> map(word -> positions) of every document's text."""
    return with_inverted_index(docs.select("doc_id", "text")).select("doc_id", "inv")


def _rec_openalex(d):
    return F.struct(
        F.concat(F.lit("https://openalex.org/W"), _s("num")).alias("id"),
        F.col("title_raw").alias("title"),
        F.transform("names", lambda n: F.struct(F.struct(n.alias("display_name")).alias("author")))
        .alias("authorships"),
        F.col("date_raw").alias("publication_date"),
        F.concat(F.lit("https://doi.org/"), "doi_raw").alias("doi"),
        F.col("inv").alias("abstract_inverted_index"), F.col("cites").alias("cited_by_count"),
        F.when(F.col("journal_raw").isNotNull(),
               F.struct(F.struct(F.col("journal_raw").alias("display_name")).alias("source")))
        .alias("primary_location"))


def _rec_crossref(d):
    y, m = _year(F.col("date_raw")), F.substring("date_raw", 6, 2).cast("int")
    k = F.col("doc_id") % 3
    parts = (F.when(k == 0, F.array(y, m, F.lit(15))).when(k == 1, F.array(y, m))
             .otherwise(F.array(y)))
    return F.struct(
        F.col("doi_raw").alias("DOI"), F.concat(F.lit("https://doi.org/"), "doi_raw").alias("URL"),
        F.array("title_raw").alias("title"),
        F.transform("names", lambda n: F.struct(n.alias("family"))).alias("author"),
        F.when(F.col("date_raw").isNotNull(), F.struct(F.array(parts).alias("date-parts")))
        .alias("published"),
        F.concat(F.lit("<jats:p>"), "text", F.lit("</jats:p>")).alias("abstract"),
        F.col("cites").alias("is-referenced-by-count"),
        F.when(F.col("journal_raw").isNotNull(), F.array("journal_raw")).alias("container-title"))


def _rec_europepmc(d):
    pid = F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("PMC"), _s("num"))).otherwise(F.lit(""))
    return F.struct(
        pid.alias("id"), F.lit("MED").alias("source"), F.col("title_raw").alias("title"),
        F.array_join("names", ", ").alias("authorString"),
        F.col("date_raw").alias("firstPublicationDate"), F.col("doi_raw").alias("doi"),
        F.col("text").alias("abstractText"), F.col("cites").alias("citedByCount"),
        F.col("journal_raw").alias("journalTitle"))


def _rec_core(d):
    return F.struct(
        F.col("num").alias("id"),
        F.concat(F.lit("https://core.ac.uk/download/"), _s("num"), F.lit(".pdf")).alias("downloadUrl"),
        F.col("title_raw").alias("title"),
        F.transform("names", lambda n: F.struct(n.alias("name"))).alias("authors"),
        F.concat("date_raw", F.lit("T00:00:00")).alias("publishedDate"),
        F.col("doi_raw").alias("doi"), F.col("text").alias("abstract"),
        F.when(F.col("journal_raw").isNotNull(), F.array(F.struct(F.col("journal_raw").alias("title"))))
        .otherwise(F.array().cast("array<struct<title:string>>")).alias("journals"))


def _v(c) -> Column:
    """A scalar or an array as a VARIANT value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("variant")


def _va(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.parse_json(F.to_json(c))


def _rec_base(d):
    doc = F.col("doc_id")
    oai = F.concat(F.lit("oai:"), _s("num"))
    listy = doc % 2 == 0
    src = F.when(doc % 3 == 0, F.concat(F.lit("http://repo.example/"), _s(doc))).otherwise(F.col("journal_raw"))
    pub = F.concat(F.lit("Pub"), _s(doc % 7))
    return F.struct(
        F.when(listy, _va(F.array_compact(F.array(oai, F.col("doi_raw"))))).otherwise(_v(oai)).alias("dcidentifier"),
        F.when(listy, _va(F.array("title_raw"))).otherwise(_v("title_raw")).alias("dctitle"),
        F.when(listy, _va("names")).otherwise(_v(F.element_at("names", 1))).alias("dccreator"),
        F.when(listy, _va(F.array(src))).otherwise(_v(src)).alias("dcsource"),
        F.when(listy, _va(F.array(pub))).otherwise(_v(pub)).alias("dcpublisher"),
        F.concat(F.lit("https://base.example/"), _s(doc)).alias("dclink"),
        _year(F.col("date_raw")).alias("dcyear"),
        F.when(listy, _va(F.array("text"))).otherwise(_v("text")).alias("dcdescription"))


def _rec_ieee_xplore(d):
    doc = F.col("doc_id")
    return F.struct(
        F.col("num").alias("article_number"),
        F.when(doc % 2 == 0, F.concat(F.lit("https://ieeexplore.example/pdf/"), _s("num"))).alias("pdf_url"),
        F.concat(F.lit("https://ieeexplore.example/document/"), _s("num")).alias("document_link"),
        F.col("title_raw").alias("title"),
        F.struct(F.transform("names", lambda n: F.struct(n.alias("full_name"))).alias("authors"))
        .alias("authors"),
        F.when(F.col("date_raw").isNotNull(), F.date_format(F.to_date("date_raw"), "d MMMM yyyy"))
        .alias("publication_date"),
        F.col("doi_raw").alias("doi"), F.col("text").alias("abstract"),
        F.col("cites").alias("citing_paper_count"), F.col("journal_raw").alias("publication_title"))


def _rec_google_scholar(d):
    doc = F.col("doc_id")
    venue_side = doc % 2 == 0
    return F.struct(
        F.when(doc % 3 != 0, F.concat(F.lit("https://scholar.example/"), _s("num"))).alias("pub_url"),
        F.col("cites").alias("num_citations"),
        F.struct(F.col("title_raw").alias("title"), F.col("names").alias("author"),
                 _year(F.col("date_raw")).alias("pub_year"), F.col("doi_raw").alias("doi"),
                 F.col("text").alias("abstract"),
                 F.when(venue_side, F.col("journal_raw")).alias("venue"),
                 F.when(~venue_side, F.col("journal_raw")).alias("journal")).alias("bib"))


def _rec_plos(d):
    doc = F.col("doc_id")
    pid = F.when(doc % 50 != 0, F.concat(F.lit("10.1371/journal."), _s("num"))).otherwise(F.lit(""))
    abstract = (F.when(doc % 9 == 0, _va(F.array().cast("array<string>")))
                .when(doc % 2 == 0, _va(F.array("text"))).otherwise(_v("text")))
    return F.struct(
        pid.alias("id"), F.col("title_raw").alias("title_display"),
        F.col("names").alias("author_display"),
        F.concat("date_raw", F.lit("T00:00:00Z")).alias("publication_date"),
        abstract.alias("abstract"), F.col("journal_raw").alias("journal"))


def _rec_doaj(d):
    doc = F.col("doc_id")
    typ = F.when(doc % 2 == 0, F.lit("DOI")).otherwise(F.lit("doi"))
    ids = F.array(F.struct(F.lit("eissn").alias("type"), F.lit("1234-5678").alias("id")),
                  F.struct(typ.alias("type"), F.col("doi_raw").alias("id")))
    return F.struct(
        F.concat(F.lit("doaj"), _s("num")).alias("id"),
        F.struct(F.col("title_raw").alias("title"),
                 F.transform("names", lambda n: F.struct(n.alias("name"))).alias("author"),
                 F.substring("date_raw", 1, 4).alias("year"), F.col("text").alias("abstract"),
                 F.when(F.col("doi_raw").isNotNull(), ids).alias("identifier"),
                 F.when(doc % 5 != 0, F.array(F.struct(
                     F.concat(F.lit("https://doaj.example/"), _s("num")).alias("url")))).alias("link"),
                 F.struct(F.col("journal_raw").alias("title")).alias("journal")).alias("bibjson"))


RECORD_BUILDERS = {
    "arxiv": _rec_arxiv, "semantic_scholar": _rec_semantic_scholar, "openalex": _rec_openalex,
    "crossref": _rec_crossref, "europepmc": _rec_europepmc, "core": _rec_core, "base": _rec_base,
    "ieee_xplore": _rec_ieee_xplore, "google_scholar": _rec_google_scholar, "plos": _rec_plos,
    "doaj": _rec_doaj,
}


# Response envelopes around the joined record texts: (prefix, separator, suffix).
ENVELOPES = {
    "arxiv": (ATOM_ROOT, "", "</feed>"),
    "semantic_scholar": ('{"data":[', ",", "]}"),
    "openalex": ('{"results":[', ",", "]}"),
    "crossref": ('{"message":{"items":[', ",", "]}}"),
    "europepmc": ('{"resultList":{"result":[', ",", "]}}"),
    "core": ('{"results":[', ",", "]}"),
    "base": ('{"response":{"docs":[', ",", "]}}"),
    "ieee_xplore": ('{"articles":[', ",", "]}"),
    "google_scholar": ("[", ",", "]"),
    "plos": ('{"response":{"docs":[', ",", "]}}"),
    "doaj": ('{"results":[', ",", "]}"),
}


def _record_text(source: str) -> Column:
    """One document's record rendered in the source's wire format."""
    rec = RECORD_BUILDERS[source](None)
    if source == "arxiv":
        # to_xml cannot write prefixed names: emit placeholders, then rename
        xml = F.to_xml(rec, {"rowTag": "entry"})
        for name in ("doi", "journal_ref"):
            xml = F.replace(xml, F.lit(f"<arxiv_{name}>"), F.lit(f"<arxiv:{name}>"))
            xml = F.replace(xml, F.lit(f"</arxiv_{name}>"), F.lit(f"</arxiv:{name}>"))
        return xml
    if source == "semantic_scholar":
        return F.to_json(rec, {"ignoreNullFields": "false"})
    return F.to_json(rec)


def build_payloads(docs: DataFrame, sources: list[str], broken: bool = False) -> DataFrame:
    """Payload rows (PAYLOADS schema): the document with ``_k == i`` becomes
    a record of ``sources[i]``; records are grouped 20 documents to a response
    (by ``chunk``). With ``broken``, responses whose ``(chunk + i) % 13 == 7``
    land a second time cut to 10 characters (unparsable: a failed task), so
    failed tasks cost no document."""
    if "openalex" in sources:
        docs = with_inverted_index(docs, when=F.col("_k") == sources.index("openalex"))
    k = F.col("_k")
    text = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(sources))):
        text = F.when(k == i, _record_text(s)).otherwise(text)
    grouped = docs.select("_k", "chunk", "doc_id", text.alias("t")).groupBy("_k", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "t"))).alias("items"))
    texts = F.transform("items", lambda x: x["t"])
    body = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(sources))):
        pre, sep, suf = ENVELOPES[s]
        body = F.when(k == i, F.concat(F.lit(pre), F.array_join(texts, sep), F.lit(suf))).otherwise(body)
        name = F.when(k == i, F.lit(s)).otherwise(name)
    cut = F.lit(False)
    if broken:
        bad = (F.col("chunk") + k) % 13 == 7
        grouped = grouped.withColumn("cut", F.explode(F.when(bad, F.array(F.lit(False), F.lit(True)))
                                                      .otherwise(F.array(F.lit(False)))))
        cut = F.col("cut")
        body = F.when(cut, F.left(body, F.lit(10))).otherwise(body)
    idx = (F.col("chunk") % 20).cast("int")
    return grouped.select(
        name.alias("source"),
        F.concat(F.lit("kw"), _s(idx)).alias("keyword"), idx.alias("keyword_idx"),
        F.timestamp_add("SECOND", F.col("chunk"), F.lit(BASE_TS).cast("timestamp_ntz")).alias("fetched_at"),
        F.lit(200).alias("status_code"), body.alias("body"),
        F.concat(name, F.lit("/"), _s("chunk"), F.when(cut, ".cut.json").otherwise(".json")).alias("file_path"))


_LANDED: dict[tuple[str, str, str], str] = {}


def payloads(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """All documents as responses of ``source``, landed once per application:
    rendering them is the stand-in's cost, not the operators'."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), source)
    if key not in _LANDED:
        path = f"{scratch_path(spark, 'landing')}"
        land_payloads(build_payloads(base(spark, sf_dir).withColumn("_k", F.lit(0)), [source]), path)
        _LANDED[key] = path
    return read_payloads(spark, _LANDED[key])


def mixed_payloads(spark: SparkSession, sf_dir: str, sources: list[str],
                   lang: str | None = None, broken: bool = True) -> DataFrame:
    """Documents spread over the sources by their own ``source`` column
    (``srcN`` goes to source N mod count); one harvest run's responses.
    ``lang`` keeps the documents of one language (an earlier, smaller run)."""
    d = base(spark, sf_dir).withColumn(
        "_k", F.regexp_extract("source", r"([0-9]+)$", 1).cast("int") % len(sources))
    if lang is not None:
        d = d.filter(F.col("lang") == lang)
    return build_payloads(d, sources, broken)
